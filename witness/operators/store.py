"""Store reads: filters, top-k and joins that every published view is made of.

All take ``now`` or bounds as arguments; every limit comes after an order with an id as tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from witness.functions.geo import around, cells, haversine_m


def items_in_window(items: DataFrame, start: str, end: str, dataset: str | None = None, limit: int | None = None) -> DataFrame:
    """Oldest first."""
    found = items.where(F.col("occurred_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if dataset is not None:
        found = found.where(F.col("dataset_id") == dataset)
    return found.orderBy("occurred_at", "item_id").limit(limit) if limit else found


def latest_occurred_at(items: DataFrame) -> DataFrame:
    return items.agg(F.max("occurred_at").alias("occurred_at"))


def items_by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids, "item_id", "left_semi")


def without_embedding(items: DataFrame, embedded: DataFrame) -> DataFrame:
    """Items that still have no vector."""
    return items.join(embedded.select("item_id"), "item_id", "left_anti")


def embedded_in_order(items: DataFrame, limit: int) -> DataFrame:
    """Embedded items by (occurred_at, source, text), never by id, so that a rebuilt store gives the same order."""
    return items.where(F.col("embedding").isNotNull()).orderBy("occurred_at", "source", "text").limit(limit)


def active_bubbles(bubbles: DataFrame, dataset: str, since: str, limit: int) -> DataFrame:
    return (
        bubbles.where((F.col("dataset_id") == dataset) & (F.col("last_seen") >= F.lit(since).cast("timestamp")))
        .orderBy(F.desc("last_seen"), F.desc("bubble_id")).limit(limit)
    )


def bubbles_overlapping(bubbles: DataFrame, start: str, end: str, limit: int) -> DataFrame:
    """Bubbles alive at some time in the window, by score."""
    at = lambda t: F.lit(t).cast("timestamp")
    return (
        bubbles.where((F.col("last_seen") >= at(start)) & (F.col("first_seen") <= at(end)))
        .orderBy(F.desc("score"), F.desc("last_seen"), F.desc("bubble_id")).limit(limit)
    )


def unlabelled(bubbles: DataFrame) -> DataFrame:
    return bubbles.where(F.col("label").isNull())


def grade_events(
    events: DataFrame, bubble: str | None = None, dataset: str | None = None, as_at: str | None = None, since: str | None = None,
    fired: bool = False, newest_first: bool = False, limit: int = 500,
) -> DataFrame:
    found = events
    if bubble is not None:
        found = found.where(F.col("bubble_id") == bubble)
    if dataset is not None:
        found = found.where(F.col("dataset_id") == dataset)
    if as_at is not None:
        found = found.where(F.col("at") <= F.lit(as_at).cast("timestamp"))
    if since is not None:
        found = found.where(F.col("at") > F.lit(since).cast("timestamp"))
    if fired:
        found = found.where("alert_fired")
    order = [F.desc("at"), F.desc("item_id")] if newest_first else ["at", "item_id"]
    return found.orderBy(*order).limit(limit)


def annotations_of(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    return annotations.join(nodes, "node_id", "left_semi")


def edges_touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a node at either end, each once."""
    ids = nodes.select(F.col("node_id").alias("_n"))
    return (
        edges.join(ids, F.col("from_id") == F.col("_n"), "left_semi")
        .unionByName(edges.join(ids, F.col("to_id") == F.col("_n"), "left_semi")).distinct()
    )


def anchored_window(items: DataFrame, now: str, hours: int | None) -> DataFrame:
    """The last ``hours`` before the later of ``now`` and the newest item; without hours all up to then."""
    newest = items.agg(F.greatest(F.max("occurred_at"), F.lit(now).cast("timestamp")).alias("_end"))
    found = items.join(F.broadcast(newest)).where(F.col("occurred_at") <= F.col("_end"))
    if hours is not None:
        found = found.where(F.col("occurred_at") >= F.col("_end") - F.expr(f"INTERVAL {hours} HOURS"))
    return found.drop("_end")


def members(items: DataFrame, edges: DataFrame, as_at: str | None = None) -> DataFrame:
    """Items with the bubble they belong to; with ``as_at`` only what was known by then."""
    found = items.drop("bubble_id").join(edges.where("rel = 'member_of'").select(F.col("from_id").alias("item_id"), F.col("to_id").alias("bubble_id")), "item_id")
    return found.where(F.col("captured_at") <= F.lit(as_at).cast("timestamp")) if as_at else found


def pending(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items without a bubble."""
    return items.join(edges.where("rel = 'member_of'").select(F.col("from_id").alias("item_id")), "item_id", "left_anti")


def unprojected(items: DataFrame, coordinates: DataFrame, kind: str) -> DataFrame:
    done = coordinates.where(F.col("kind") == kind).select("item_id")
    return items.where(F.col("embedding").isNotNull()).join(done, "item_id", "left_anti")


def points(items: DataFrame, coordinates: DataFrame, edges: DataFrame) -> DataFrame:
    """Items with their projection and bubble, null where they have none."""
    bubble = edges.where("rel = 'member_of'").select(F.col("from_id").alias("item_id"), F.col("to_id").alias("bubble"))
    return items.join(coordinates, "item_id", "left").join(bubble, "item_id", "left")


def with_reliability(rows: DataFrame, registry: DataFrame, source: str = "source") -> DataFrame:
    """Adds ``reliability``: of the exact source, else of its trimmed lower-case form, else null."""
    known = registry.select(F.col("source").alias("_s"), F.col("reliability").alias("_r")).dropDuplicates(["_s"])
    exact = rows.join(known, F.col(source) == F.col("_s"), "left").withColumnRenamed("_r", "_exact").drop("_s")
    loose = exact.join(known, F.lower(F.trim(F.col(source))) == F.col("_s"), "left").withColumnRenamed("_r", "_loose").drop("_s")
    return loose.withColumn("reliability", F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


#: Copies of a data set's latest bubbles, each for a share of its items.
COPIES = 64


def _latest(bubbles: DataFrame, limit: int) -> DataFrame:
    """Of each data set (``_d``) the ``limit`` bubbles seen last."""
    order = Window.partitionBy("_d").orderBy(F.desc("last_seen"), F.desc("bubble_id"))
    return bubbles.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit).drop("_k")


def candidate_lists(items: DataFrame, bubbles: DataFrame, hours: int = 6, metres: float = 1500.0, limit: int = 50) -> DataFrame:
    """Every item with ``found``: what ``candidates`` with ``keep_far`` pairs it with, as an array of structs (bubble_id,
    last_seen, metres, far), for limits so small that a row can hold it.  No pair is made, so none is shuffled or sorted.
    """
    b = bubbles.select(F.col("dataset_id").alias("_d"), "bubble_id", "last_seen", F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    lists = _latest(b, limit).groupBy("_d").agg(F.collect_list(F.struct("bubble_id", "last_seen", "b_lat", "b_lng")).alias("_all"))
    # The few lists are copied, so that a large data set's items go to many tasks.
    lists = lists.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = items.withColumn("_p", F.pmod(F.xxhash64("item_id"), F.lit(COPIES)))
    met = dealt.join(lists, (F.col("dataset_id") == F.col("_d")) & (F.col("_p") == F.col("_q")), "left").drop("_p", "_q", "_d")
    open_still = lambda x: x["last_seen"] >= F.col("occurred_at") - F.expr(f"INTERVAL {hours} HOURS")
    apart = lambda x: haversine_m(F.col("lat"), F.col("lng"), x["b_lat"], x["b_lng"]).alias("metres")
    told = F.transform(F.filter("_all", open_still), lambda x: F.struct(x["bubble_id"].alias("bubble_id"), x["last_seen"].alias("last_seen"), apart(x)))
    told = F.transform(told, lambda x: x.withField("far", F.coalesce(x["metres"] > metres, F.lit(False))))
    return met.withColumn("found", F.coalesce(told, F.array())).drop("_all")


def candidates(
    items: DataFrame, bubbles: DataFrame, hours: int = 6, metres: float = 1500.0, candidate_limit: int | None = 50, keep_far: bool = False
) -> DataFrame:
    """Bubbles that each item could join: same data set, seen in the ``hours`` before it or later, near if both are placed.

    These are the bubbles of one time for all items; ``arrivals.candidates`` has them as each item found them.  With
    ``keep_far`` those beyond the distance stay, told by ``far`` (only with a limit).

    The most recently seen ``candidate_limit`` are taken before distance counts, as a busy region's rule demands. Open
    is a bound on last_seen alone, so an item's latest open bubbles are the open ones among its data set's latest: those
    are found first, and no item meets more than that many.

    Without a limit (scale mode, a different result) a bubble must also have begun by ``hours`` after the item. Placed
    items meet placed bubbles by cell and time bucket, and all others by time bucket alone.
    """
    b = bubbles.select(
        "bubble_id", F.col("dataset_id").alias("_d"), "first_seen", "last_seen", F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), *[c for c in ("centroid",) if c in bubbles.columns]
    )
    items, gap = items.drop("bubble_id", "centroid"), F.expr(f"INTERVAL {hours} HOURS")
    apart = haversine_m(F.col("lat"), F.col("lng"), F.col("b_lat"), F.col("b_lng"))
    open_still = F.col("last_seen") >= F.col("occurred_at") - gap
    if candidate_limit is not None:
        b = _latest(b, candidate_limit).drop("first_seen")
        # The few bubbles are copied, so that a large data set's items go to many tasks.
        items = items.withColumn("_p", F.pmod(F.xxhash64("item_id"), F.lit(COPIES)))
        b = b.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        pairs = items.join(b, (F.col("dataset_id") == F.col("_d")) & (F.col("_p") == F.col("_q")) & open_still).drop("_p", "_q")
    else:
        span = hours * 3600
        bucket = lambda c: F.floor(F.unix_seconds(c) / span)
        b = b.withColumn("_b", F.explode(F.sequence(bucket("first_seen") - 1, bucket("last_seen") + 1)))
        timed = items.withColumn("_t", bucket("occurred_at"))
        same = (F.col("dataset_id") == F.col("_d")) & (F.col("_t") == F.col("_b")) & open_still & (F.col("first_seen") <= F.col("occurred_at") + gap)
        placed, b_placed = F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("b_lat").isNotNull() & F.col("b_lng").isNotNull()
        here = timed.where(placed).withColumn("_c", cells(F.col("lat"), F.col("lng"), metres))
        spread = around(b.where(b_placed), metres, "_e", "b_lat", "b_lng")
        by_cell = here.join(spread, same & (F.col("_c") == F.col("_e"))).drop("_c", "_e")
        loose = timed.where(~placed).join(b, same).unionByName(timed.where(placed).join(b.where(~b_placed), same))
        pairs = by_cell.unionByName(loose).drop("_t", "_b", "first_seen")
    return within_reach(pairs.withColumn("metres", apart).drop("_d"), metres, keep_far)


def within_reach(pairs: DataFrame, metres: float, keep_far: bool = False) -> DataFrame:
    """Pairs whose ``metres`` are unknown or in reach; or all, with whether they are ``far``."""
    far = F.coalesce(F.col("metres") > metres, F.lit(False))
    return pairs.withColumn("far", far) if keep_far else pairs.where(~far)


def last_before(events: DataFrame, as_at: str, by: str = "bubble_id") -> DataFrame:
    """Each key's last event at or before ``as_at``."""
    known = events.where(F.col("at") <= F.lit(as_at).cast("timestamp"))
    rest = [c for c in events.columns if c != by]
    return known.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("at", "item_id")).alias("e")).select(by, "e.*")


def same_day(mentions: DataFrame, days: DataFrame, at: str = "at") -> DataFrame:
    """Adds whether a measured day has the mention's date."""
    known = days.select(F.col("day").alias("_day")).distinct()
    return mentions.join(known, F.to_date(at) == F.col("_day"), "left").withColumn("same_day", F.col("_day").isNotNull()).drop("_day")


def first_sentence(members: DataFrame, text: Column) -> DataFrame:
    """Members and the earliest sentence of each bubble."""
    return members.groupBy("bubble_id").agg(F.count(F.lit(1)).alias("n_members"), F.min_by(text, F.struct("occurred_at", "item_id")).alias("first"))
