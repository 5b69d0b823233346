"""Counting witnesses: which items of a bubble restate one observation.

Links between items of a bubble come from wording, restatement, quotes and authorship; linked items, over any number of
steps, are one origin.  Input columns: bubble_id, item_id (long), source, author, url, quoted_urls, text, occurred_at,
and for restatements embedding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witness.functions.vectors import cosine
from witness.operators import setjoin
from witness.operators.graph import components, spanning_forest
from witness.plans.lineage import cut, drop_cut

SAME_WORDING = 0.85
RESTATED_OVERLAP, RESTATED_COSINE = 0.5, 0.95
#: Different vectors of which every two are compared, so that items meet by them.
MAX_KINDS = 256


def tokens(text: Column) -> Column:
    """Different lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def _first(order: tuple[str, ...]) -> Column:
    """The id of the first row by ``order``."""
    return F.min_by("item_id", F.struct(*order, "item_id"))


def _first_of_equal(items: DataFrame, order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(bubble_id, item_id, t of the first of each different token set by ``order``; links of the others to it)."""
    sets = items.select("bubble_id", "item_id", *order, tokens(F.col("text")).alias("t")).where("size(t) > 0")
    # Tokens hold no blanks, so equal digests are equal sets.
    key = cut(sets.select("bubble_id", "item_id", *order, "t", F.md5(F.concat_ws(" ", F.array_sort("t"))).alias("k")))
    first = key.groupBy("bubble_id", "k").agg(F.min_by("item_id", F.struct(*order, "item_id")).alias("item_id"))
    first = cut(key.drop("k", *order).join(first, ["bubble_id", "item_id"]))
    ids = cut(key.select("bubble_id", "item_id", "k"))
    drop_cut(key)
    twins = ids.join(first.select("bubble_id", "k", F.col("item_id").alias("a")), ["bubble_id", "k"]).where("item_id <> a")
    return first.drop("k"), twins.select("bubble_id", "a", F.col("item_id").alias("b"), F.lit(1.0).alias("overlap"))


def overlapping(items: DataFrame, least: float, order: tuple[str, ...] = ()) -> DataFrame:
    """bubble_id, a, b (a < b), overlap: pairs of a bubble whose token sets have a Jaccard overlap of ``least`` or more.

    Two such sets share a token among the rarest of each, so only those meet (``setjoin.all_pairs``); no pair is made of
    items that share common words alone.  Exact: every pair is checked on the whole sets.  Items with equal sets are linked
    to the first of them by ``order``.
    """
    sets, twins = _first_of_equal(items, order)
    return setjoin.all_pairs(sets, least).unionByName(twins)


def wording_links(items: DataFrame) -> DataFrame:
    """bubble_id, a, b, overlap: links that connect the items of near-identical wording, some one or two for each item.

    Items with equal token sets are linked to the first of them; of different sets ``setjoin.links`` gives as many links
    as connect them.  ``overlapping`` lists all pairs of different sets.
    """
    sets, twins = _first_of_equal(items)
    return setjoin.links(sets, SAME_WORDING).unionByName(twins)


def _kinds(sets: DataFrame) -> DataFrame | None:
    """embedding, kind, block, alike: different vectors of ``sets``, if they are few, with the kinds close to each; kinds
    that closeness connects have one block."""
    found = cut(sets.select("embedding").distinct().limit(MAX_KINDS + 1))
    if found.count() > MAX_KINDS:
        return None
    named = cut(found.coalesce(1).withColumn("kind", F.monotonically_increasing_id()))
    other = named.select(F.col("embedding").alias("_e"), F.col("kind").alias("_k"))
    near = cut(named.crossJoin(F.broadcast(other)).where(cosine(F.col("embedding"), F.col("_e")) >= RESTATED_COSINE).groupBy("kind").agg(F.array_sort(F.collect_set("_k")).alias("alike")))
    root = components(near.select(F.col("kind").alias("a"), F.explode("alike").alias("b")))
    block = near.join(root, F.col("kind") == F.col("node"), "left").select("kind", F.coalesce("root", "kind").alias("block"), "alike")
    return cut(named.join(block, "kind"))


def restatement_links(items: DataFrame) -> DataFrame:
    """bubble_id, a, b, overlap, cosine: links that connect items close in meaning that also share half of their words.

    Where different vectors are few (``MAX_KINDS``), only items of close kinds meet, and no vector goes with a pair.
    """
    sets = cut(items.select("bubble_id", "item_id", tokens(F.col("text")).alias("t"), "embedding").where("size(t) > 0 AND embedding IS NOT NULL AND bubble_id IS NOT NULL"))
    close = lambda a, b: cosine(F.col(f"{a}_embedding"), F.col(f"{b}_embedding"))
    kinds = _kinds(sets)
    if kinds is None:
        found = setjoin.links(sets, RESTATED_OVERLAP, lambda a, b: close(a, b) >= RESTATED_COSINE)
    else:
        # A kind that isn't close to itself (a vector without length) and to no other is in no pair.
        told = sets.join(F.broadcast(kinds), "embedding").select(F.struct("bubble_id", "block").alias("bubble_id"), "item_id", "t", "kind", "alike")
        found = cut(setjoin.block_links(told, RESTATED_OVERLAP)).withColumn("bubble_id", F.col("bubble_id.bubble_id"))
    v = lambda c: sets.select("bubble_id", F.col("item_id").alias(c), F.col("embedding").alias(f"{c}_embedding"))
    both = found.join(v("a"), ["bubble_id", "a"]).join(v("b"), ["bubble_id", "b"])
    return both.withColumn("cosine", close("a", "b")).drop("a_embedding", "b_embedding")


def plain_url(url: Column) -> Column:
    """Without scheme, www., case and closing slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", ""), "/+$", "")


def quote_links(items: DataFrame) -> DataFrame:
    """bubble_id, a (quoted), b (quoting), u: each once.  Repeats go before the join, whose pairs no task then holds."""
    own = items.where("url IS NOT NULL").select("bubble_id", F.col("item_id").alias("a"), plain_url(F.col("url")).alias("u")).distinct()
    quoted = items.select("bubble_id", F.col("item_id").alias("b"), F.explode("quoted_urls").alias("q")).select("bubble_id", "b", plain_url(F.col("q")).alias("u")).distinct()
    return own.hint("merge").join(quoted.hint("merge"), ["bubble_id", "u"]).where("a <> b").select("bubble_id", "a", "b", "u")


def quote_chains(items: DataFrame) -> DataFrame:
    """bubble_id, a, b, u: links with the components and the addresses of ``quote_links``, one for each item and address.

    Where an address has items that it names and items that quote it, all of them are connected, so each is linked to the first.
    """
    own = items.where("url IS NOT NULL").select("bubble_id", "item_id", plain_url(F.col("url")).alias("u"), F.lit(True).alias("named"))
    quoted = items.select("bubble_id", "item_id", F.explode("quoted_urls").alias("q")).select("bubble_id", "item_id", plain_url(F.col("q")).alias("u"), F.lit(False).alias("named"))
    rows = cut(own.unionByName(quoted).where("u IS NOT NULL AND bubble_id IS NOT NULL").distinct())
    first = rows.groupBy("bubble_id", "u").agg(F.min("item_id").alias("a"), F.bool_or("named").alias("n"), F.bool_and("named").alias("m")).where("n AND NOT m").drop("n", "m")
    return rows.select("bubble_id", "u", F.col("item_id").alias("b")).distinct().join(first, ["bubble_id", "u"]).where("a <> b").select("bubble_id", "a", "b", "u")


def quote_arrivals(items: DataFrame, order: tuple[str, ...] = ("captured_at",)) -> DataFrame:
    """bubble_id, a, b: links of ``quote_links`` that connect, up to any time by ``order``, what all of those up to it connect.

    Of an address each item that quotes it is linked to the first that it names, and each that it names to the first
    quoting: at most one link for each item and address, not one for each pair.
    """
    side = lambda c, named: items.select("bubble_id", "item_id", *order, c.alias("u")).select("bubble_id", "item_id", *order, plain_url(F.col("u")).alias("u"), F.lit(named).alias("named"))
    rows = cut(side(F.col("url"), True).unionByName(side(F.explode("quoted_urls"), False)).where("u IS NOT NULL AND bubble_id IS NOT NULL").distinct())
    first = rows.groupBy("bubble_id", "u").agg(*(F.min(F.when(F.col("named") == named, F.struct(*order, "item_id"))).alias(c) for c, named in (("_n", True), ("_q", False))))
    first = first.where("_n IS NOT NULL AND _q IS NOT NULL")
    other = F.when(F.col("named"), F.col("_q.item_id")).otherwise(F.col("_n.item_id"))
    return rows.join(first, ["bubble_id", "u"]).select("bubble_id", other.alias("a"), F.col("item_id").alias("b")).where("a <> b")


def author_links(items: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Each item of a (source, author) with the first by ``order``; items without an author are never linked by it."""
    who = F.lower(F.trim(F.col("author")))
    named = items.where(F.trim(F.col("author")) != "").select("bubble_id", "item_id", *order, "source", who.alias("who"))
    first = named.groupBy("bubble_id", "source", "who").agg(_first(order).alias("a"))
    return named.join(first, ["bubble_id", "source", "who"]).where("item_id <> a").select("bubble_id", "a", F.col("item_id").alias("b"), "who")


def links(items: DataFrame, with_embedding: bool = False) -> DataFrame:
    """bubble_id, a, b, why: links of all rules, each with its sentence."""
    wording = wording_links(items).select("bubble_id", "a", "b", F.format_string("near-identical wording (%.2f token overlap) — copy-paste, not corroboration", "overlap").alias("why"))
    quotes = quote_chains(items).select("bubble_id", "a", "b", F.concat(F.lit("quotes "), "u", F.lit(" — a repost is not a second witness")).alias("why"))
    authors = author_links(items).select("bubble_id", "a", "b", F.concat(F.lit("same author ("), "who", F.lit(") on the same source — one witness")).alias("why"))
    found = wording.unionByName(quotes).unionByName(authors)
    if with_embedding:
        again = restatement_links(items)
        found = found.unionByName(again.select("bubble_id", "a", "b", F.format_string("restates it (cosine %.2f, %.2f token overlap)", "cosine", "overlap").alias("why")))
    return found


def arrival_links(items: DataFrame) -> DataFrame:
    """bubble_id, a, b, later: links of all rules but restatement, and which of the two arrives later (captured_at, item_id).

    Links among copies, of an author or by an address all lead to their first arrivals, so links whose later end has arrived
    by some time make the origins of what is known then.
    """
    order = ("captured_at",)
    # All pairs: of links that merely connect, one may arrive later than the pair it stands for.
    found = overlapping(items, SAME_WORDING, order).select("bubble_id", "a", "b").unionByName(quote_arrivals(items, order))
    found = found.unionByName(author_links(items, order).select("bubble_id", "a", "b"))
    at = lambda c: items.select(F.col("item_id").alias(c), F.struct("captured_at", "item_id").alias(f"_{c}"))
    both = found.join(at("a"), "a").join(at("b"), "b")
    return both.select("bubble_id", "a", "b", F.greatest("_a", "_b").alias("later"))


def merges(items: DataFrame) -> DataFrame:
    """item_id, merged: how many sets of linked items an arrival makes one with itself, less the first; only where some.

    A spanning forest of the links by arrival has as many edges up to a time as there are then items less origins.
    """
    found = spanning_forest(arrival_links(items).select("a", "b", F.col("later").alias("w")))
    return found.groupBy(F.col("w.item_id").alias("item_id")).agg(F.count(F.lit(1)).alias("merged"))


def assign_origins(items: DataFrame, found: DataFrame) -> DataFrame:
    """bubble_id, item_id, origin_id: the earliest item (of equals the smallest id) of each set of linked items.

    Item ids must be unique over bubbles, since sets never span them.
    """
    root = components(found.select("a", "b"))
    rows = items.select("bubble_id", "item_id", "occurred_at").join(root, F.col("item_id") == F.col("node"), "left").withColumn("_r", F.coalesce("root", "item_id"))
    first = rows.groupBy("bubble_id", "_r").agg(F.min_by("item_id", F.struct("occurred_at", "item_id")).alias("origin_id"))
    return rows.join(first, ["bubble_id", "_r"]).select("bubble_id", "item_id", "origin_id")


def wording_classes(items: DataFrame) -> DataFrame:
    """item_id, class_id: the smallest id that near-identical wording leads to, over any number of steps."""
    root = components(wording_links(items).select("a", "b"))
    return items.select("item_id").join(root, F.col("item_id") == F.col("node"), "left").select("item_id", F.coalesce("root", "item_id").alias("class_id"))


def linked_origins(items: DataFrame) -> DataFrame:
    """The same from the links among just these items."""
    return assign_origins(items, links(items))


def author_origins(items: DataFrame) -> DataFrame:
    """The same from authorship alone, which needs no chaining: one aggregation and one join."""
    key = F.when(F.trim(F.col("author")) != "", F.concat_ws("|", "source", F.lower(F.trim(F.col("author"))))).otherwise(F.concat(F.lit("#"), F.col("item_id").cast("string")))
    rows = items.withColumn("_k", key)
    first = rows.groupBy("bubble_id", "_k").agg(F.min_by("item_id", F.struct("occurred_at", "item_id")).alias("origin_id"))
    return rows.join(first, ["bubble_id", "_k"]).drop("_k")


def origin_counts(origins: DataFrame) -> DataFrame:
    return origins.groupBy("bubble_id").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("origin_id").alias("independent_sources"))


def origin_groups(origins: DataFrame, found: DataFrame) -> DataFrame:
    """bubble_id, origin_id, items, why: collapsed sets with the sentences that collapsed them."""
    sets = origins.groupBy("bubble_id", "origin_id").agg(F.count(F.lit(1)).alias("items"))
    told = found.join(origins, (found.b == origins.item_id) & (found.bubble_id == origins.bubble_id)).groupBy("origin_id").agg(F.array_sort(F.collect_set("why")).alias("why"))
    return sets.where("items > 1").join(told, "origin_id", "left")
