"""Near-duplicate groups by the exact Jaccard similarity of word shingles.

Two sets whose similarity reaches ``least`` share a member among the first ``n - ceil(least * n) + 1`` of each in any
one order of all shingles (their *keys*), so an equality join on those finds every such pair: no fingerprint radius
bounds it.  Shingles of many documents are put last in the order: a passage that many documents share gives keys only
to those that hold little else, so it makes no list of their pairs.  Which shingles those are is counted over a fixed
share of the documents and kept as a bitmap; a wrong bit moves a shingle in the order of all documents alike and changes
the cost only.

Near copies are first met by their SimHash fingerprints (``simhash``): sets of fingerprints within four bits are
candidates like those of shared keys, and what such a pair joins needs no more comparisons.  No fingerprint decides
alone, and what lies beyond four bits is found by the keys.

Whole sets are as large as the texts and never stored.  A pair is first bounded by its keys: what two sets share is at
most what their keys share and the rest of either set.  Only documents of pairs that pass are read again for the exact
comparison of their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witness.llm import simhash
from witness.llm.common import components, cut, drop_cut, parts

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
SEED = 42
#: One document in SHARE is looked at for common shingles, which are those of at least COMMON of them.
SHARE, COMMON = 8, 4
#: Fewest and most bits of the map of common shingles, which has about 16 for each.
COMMON_BITS = (1 << 20, 1 << 28)
#: Sets of one key that meet in one row; more are met block by block.
BLOCK = 2_000
#: Bits of the map by which documents that are in no pair are passed over before they are cut into words again.
MARKS = 1 << 22


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle of all its words, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    k = min(shingle_words, len(words))
    each = zip(*(words[i:] for i in range(k)), strict=False)
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(b" ".join(x), SEED) for x in each), np.uint64, len(words) - k + 1).view(np.int64))


def _set_hash(w: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(w.tobytes(), SEED) if len(w) else 0


def _row(docs: DataFrame) -> list:
    """doc_id, text, and a hash of both that finds the row again."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("row")]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each value of ``column`` modulo ``bits``, packed: bits / 8 bytes come to the driver, in few rows."""
    at = F.pmod(column, F.lit(bits)) + 1
    pieces = values.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        some = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.k - 1) * len(some) : r.k * len(some)] = some
    return out


def _held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _common(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """The map of common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = [shingle_set(x.as_py(), shingle_words) for x in batch["text"].slice(at, 256)]
                w, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], ["w", "n"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0).mapInArrow(run, "w long, n long")
    often = cut(some.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).select("w"))
    bits, most = COMMON_BITS
    n = often.count()
    while bits < most and bits < 16 * n:
        bits *= 2
    found = _bitmap(often, "w", bits)
    drop_cut(often)
    return found


def keyed(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, least: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, row, fp (hash of the set, 0 without words), n (its size), keys, sim (SimHash): one row for each row of ``docs``."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, keys, sims = [], [], [], []
            for x in batch["text"]:
                w = shingle_set(text := x.as_py(), shingle_words)
                sims.append(simhash.fingerprint(text))
                fps.append(_set_hash(w))
                sizes.append(len(w))
                late = _held(common.value, w)
                w = np.concatenate([w[~late], w[late]])
                keys.append(w[: len(w) - math.ceil(least * len(w) - 1e-9) + 1])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row"], pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(keys), pa.array(np.array(sims, np.uint64).view(np.int64))],
                ["doc_id", "row", "fp", "n", "keys", "sim"],
            )

    return docs.select(*_row(docs)).mapInArrow(run, "doc_id long, row long, fp long, n int, keys array<long>, sim long")


def _whole_sets(docs: DataFrame, need: DataFrame, shingle_words: int) -> DataFrame:
    """fp, w: the whole set of each ``fp`` of ``need`` (fp, row), read from the document that ``row`` names."""
    marked = docs.sparkSession.sparkContext.broadcast(_bitmap(need, "row", MARKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(_held(marked.value, batch["row"].to_numpy())))
            for at in range(0, len(some), 256):
                part = some.slice(at, 256)
                sets = [shingle_set(x.as_py(), shingle_words) for x in part["text"]]
                fps = np.array([_set_hash(w) for w in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(fps), _lists(sets)], ["row", "fp", "w"])

    found = docs.select("text", _row(docs)[2]).mapInArrow(run, "row long, fp long, w array<long>")
    return found.join(need, ["fp", "row"], "left_semi").groupBy("fp").agg(F.first("w").alias("w"))


def _verified(pairs: DataFrame, one: DataFrame, docs: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """Of (a, b) those whose sets reach ``least``."""
    sides = [one.select(F.col("fp").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("row", "n", "keys"))) for s in "ab"]
    most = F.size(F.array_intersect("keys_a", "keys_b")) + F.greatest(F.col("n_a") - F.size("keys_a"), F.col("n_b") - F.size("keys_b"))
    enough = lambda o: o * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9
    maybe = cut(pairs.join(sides[0], "a").join(sides[1], "b").where(enough(most)).select("a", "b", "n_a", "n_b", "row_a", "row_b"))
    need = cut(
        maybe.select(F.explode(F.array(F.struct(F.col("a").alias("fp"), F.col("row_a").alias("row")), F.struct(F.col("b").alias("fp"), F.col("row_b").alias("row")))).alias("x"))
        .select("x.*")
        .distinct()
    )
    w = cut(_whole_sets(docs, need, shingle_words))
    both = (
        maybe.join(w.select(F.col("fp").alias("a"), F.col("w").alias("x")), "a")
        .join(w.select(F.col("fp").alias("b"), F.col("w").alias("y")), "b")
        .where(enough(F.size(F.array_intersect("x", "y"))))
    )
    out = cut(both.select("a", "b"))
    for df in (maybe, need, w):
        drop_cut(df)
    return out


def _across(groups: DataFrame, least: float) -> DataFrame:
    """(a, b) of members of different components that can reach ``least`` by their sizes and the key's places.

    Two sets meet in every key they share, so what a set meets is listed by key and united before pairs are made of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, others = [], []
            for row in batch["rows"]:
                m = row.values
                fp, n, pos, comp = (m.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "n", "pos", "comp"))
                order = np.argsort(fp)
                fp, n, pos, comp = fp[order], n[order], pos[order], comp[order]
                for i in range(len(fp) - 1):
                    rest = slice(i + 1, None)
                    need = np.ceil(least / (1 + least) * (n[i] + n[rest]) - 1e-9)
                    ok = (comp[rest] != comp[i]) & (np.minimum(n[i] - pos[i], n[rest] - pos[rest]) >= need)
                    if ok.any():
                        one.append(fp[i])
                        others.append(fp[rest][ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(one, np.int64)), _lists(others)], ["a", "bs"])

    met = groups.select("rows").mapInArrow(run, "a long, bs array<long>")
    return met.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")).select("a", F.explode("bs").alias("b"))


def fingerprint_pairs(one: DataFrame) -> DataFrame:
    """(a, b): candidates whose fingerprints (``sim``) are within four bits: each set with the first of its fingerprint, and
    the first ones of fingerprints that Golay keys link."""
    first = cut(one.groupBy("sim").agg(F.min("fp").alias("first")))
    near = simhash.links(first.select(F.col("sim").alias("fp")))
    at = lambda c: first.select(F.col("sim").alias(c), F.col("first").alias(f"{c}_first"))
    across = near.join(at("a"), "a").join(at("b"), "b").select("a_first", "b_first")
    within = one.select("fp", "sim").join(first, "sim").where("fp <> first").select("fp", "first")
    x, y = F.col("fp"), F.col("first")
    return within.unionByName(across.toDF("fp", "first")).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def links(one: DataFrame, docs: DataFrame, shingle_words: int = SHINGLE_WORDS, least: float = MIN_SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): links of ``least`` or more between different sets that give the components of all such links.

    ``one`` has a row (fp, row, n, keys, sim) for each different set, ``row`` naming a document of ``docs`` with that set.
    """
    shared = cut(one.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1"))
    held = cut(one.select("fp", "n", F.posexplode("keys").alias("pos", "key")).join(shared.withColumnRenamed("count", "members"), "key"))
    drop_cut(shared)
    # First each set with one set of each key, the one whose keys most sets hold: an original among its edited copies
    # has most in common with all, so that a large group of near copies becomes one component.
    heard = held.groupBy("fp").agg(F.sum("members").alias("heard"))
    ends = held.join(heard, "fp").groupBy("key").agg(F.max(F.struct("heard", "fp", "n")).alias("e"))
    ends = held.join(ends, "key").where((F.col("fp") != F.col("e.fp")) & (F.least("n", "e.n") >= least * F.greatest("n", "e.n") - 1e-9))
    ends = ends.select(F.least("fp", "e.fp").alias("a"), F.greatest("fp", "e.fp").alias("b"))
    tried = cut(fingerprint_pairs(one).unionByName(ends).distinct())
    sure = _verified(tried, one, docs, shingle_words, least)
    # Then what still lies in different components.
    roots = components(sure)
    named = cut(held.join(roots, held.fp == roots.node, "left").select("key", "fp", "n", "pos", "members", F.coalesce("root", "fp").alias("comp")))
    drop_cut(held)
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    m = F.ceil(F.col("members") / block)
    groups = (
        named.join(mixed, "key", "left_semi")
        .withColumn("own", F.pmod(F.xxhash64("fp"), m))
        .withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
        .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list(F.struct("fp", "n", "pos", "comp")).alias("rows"))
        .where(F.size("rows") > 1)
    )
    rest = cut(_across(groups, least).join(tried, ["a", "b"], "left_anti"))
    drop_cut(named)
    drop_cut(tried)
    return sure.unionByName(_verified(rest, one, docs, shingle_words, least))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, least: float = MIN_SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (hash of the set), component_id: every row of ``docs`` with the smallest doc_id linked to it.

    Texts of equal sets are linked without listing them, different sets at a similarity of ``least`` or more, and
    links chain.  Null, empty and wordless texts have fp 0 and form one group of their own.  Rows with a null doc_id
    are rows like any other; a group of only such rows has a null component.  Repeated rows come back as often as they
    are in ``docs``.  An empty table gives an empty result; other columns are not looked at.
    """
    own = cut(keyed(docs, shingle_words, least))
    one = cut(
        own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("sim").alias("sim"))
        .repartition(parts(docs.sparkSession), "fp")
    )
    roots = components(links(one.where("n > 0"), docs, shingle_words, least, block))
    group = one.select("fp", "first").join(roots, one.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = group.join(group.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return own.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")
