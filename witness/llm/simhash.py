"""Near-duplicate groups by SimHash with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a 23-bit word of the perfect binary Golay
code.  Every 23-bit word lies within 3 bits of exactly one codeword.  A word's *fuzzy keys* are the codewords found by
decoding it and the 23 words one bit away (1 or 6 different ones); two words up to 2 bits apart share such a key, since
the decoding of the word between them is in both lists, and of two words 1 bit apart each has the other's decoding in
its list.  Four differing bits spread over three segments leave, in some pair of segments,

* one bit or none in each: match (fuzzy keys of the first, decoding of the second) against (decoding of the first,
  fuzzy keys of the second), or
* none in one segment and two in each of the others: match (the exact segment, fuzzy keys of the next one).

So both lists together find every pair within four bits, with keys of 24 and 33 bits.  Candidates are verified by
counting the differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witness.llm.common import components, cut, parts

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as an unsigned 64-bit integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        return hashed(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    n = len(words) - shingle_words + 1
    for at in range(0, n, 1 << 20):  # a bounded number of shingles at a time
        some = words[at : at + (1 << 20) + shingle_words - 1]
        each = zip(*(some[k:] for k in range(shingle_words)), strict=False)
        h = np.array([hashed(b" ".join(x), SEED) for x in each], np.uint64)
        ones += _ones(h)
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: counts of byte values, then of their bits."""
    lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANE
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle_words) for x in batch["text"]), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- Golay code


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2^11 syndromes the error of weight <= 3, and the remainders of the 23 single bits."""
    rest = np.zeros(23, np.int64)
    for k in range(23):
        x = 1 << k
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        rest[k] = x
    error = np.zeros(2048, np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                e = (1 << i) | (1 << j) | (1 << k)
                s = 0
                for b in {i, j, k}:
                    s ^= int(rest[b])
                error[s] = e
    error[0] = 0
    return error, rest


_ERROR, _REST = _golay_tables()


def _syndrome(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(23):
        out ^= np.where(x >> k & 1, _REST[k], 0)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (x ^ _ERROR[_syndrome(x)]) >> 11


def fuzzy_keys(x: np.ndarray) -> np.ndarray:
    """For each word 24 codeword indices, with repeats: of itself, then of the words one bit away."""
    s = _syndrome(x)
    cols = [(x ^ _ERROR[s]) >> 11]
    for k in range(23):
        y = x ^ (1 << k)
        cols.append((y ^ _ERROR[s ^ _REST[k]]) >> 11)
    return np.stack(cols, 1)


def block_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that any two fingerprints within four bits share a key."""
    u = fps.view(np.uint64)
    seg = [(u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [fuzzy_keys(s) for s in seg]
    row = np.repeat(np.arange(len(fps)), 24)
    keys, rows = [], []
    for p, (i, j) in enumerate(((0, 1), (1, 2), (0, 2))):
        for a, b in ((near[i], near[j][:, :1]), (near[i][:, :1], near[j])):
            keys.append((np.int64(p) << 40 | np.broadcast_to(a, near[0].shape) << 12 | b).ravel())
            rows.append(row)
    for p, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):
        keys.append((np.int64(p + 3) << 40 | seg[i][:, None] << 12 | near[j]).ravel())
        rows.append(row)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])] if len(key) else np.zeros(0, bool)
    return row[new], key[new]


# ---------------------------------------------------------------- links


def _within(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of at most ``max_bits`` that join up all that such links join up among ``fps``: one tree for each part.

    Walks from value to value; each one reached takes its neighbours out of the values left, so dense parts cost
    little and no list of all pairs is made.
    """
    left, out = fps.astype(np.int64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= max_bits
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, block: int = 20_000) -> DataFrame:
    """(a, b): verified links between distinct fingerprints (column ``fp``) that give the components of all such links.

    A key's values are split into blocks of about ``block``, and every two blocks of it meet in a row of their own, so
    that no task holds more than two blocks, however many fingerprints share a key.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find pairs up to {MAX_BITS} bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                row, key = block_keys(fps[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at : at + 4096][row])], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch["fps"]
            ends = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)
            size = np.diff(ends)
            left, right = [], []
            for n in np.unique(size):
                at = ends[:-1][size == n]
                if n <= 6:  # few: all pairs of all such rows at once
                    m = flat[at[:, None] + np.arange(n)]
                    i, j = np.triu_indices(n, 1)
                    x, y = m[:, i].ravel(), m[:, j].ravel()
                    ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits) & (x != y)
                    left.append(x[ok])
                    right.append(y[ok])
                else:
                    for k in at:
                        found = _within(np.unique(flat[k : k + n]), max_bits)
                        if found:
                            x, y = np.array(found, np.int64).T
                            left.append(x)
                            right.append(y)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    keyed = distinct_fps.select("fp").mapInArrow(emit, "key long, fp long")
    hot = cut(keyed.groupBy("key").count().where(F.col("count") > block))
    if hot.isEmpty():
        groups = keyed.groupBy("key").agg(F.collect_list("fp").alias("fps"))
    else:
        n = F.coalesce(F.ceil(F.col("count") / block), F.lit(1))
        own = F.pmod(F.xxhash64("fp"), n)
        groups = (
            keyed.join(hot, "key", "left")
            .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
            .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
            .agg(F.collect_list("fp").alias("fps"))
        )
    return groups.where(F.size("fps") > 1).select("fps").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed long), component_id: every row of ``docs`` with the smallest doc_id linked to it.

    Texts of one fingerprint are linked without listing them; different fingerprints are linked at ``max_bits`` or
    fewer differing bits, and links chain.  Null, empty and wordless texts have fingerprint 0 and are linked like any
    other.  Rows with a null doc_id get a fingerprint and, with no other member, a null component.  Repeated rows come
    back as often as they are in ``docs``.  An empty table gives an empty result; other columns are not looked at.
    """
    own = cut(fingerprints(docs, shingle_words))
    # Values are few beside rows; a value's rows combine before they are shuffled.
    first = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")).repartition(parts(docs.sparkSession), "fp"))
    pairs = links(first, max_bits)
    roots = components(pairs)
    group = (
        first.join(roots, first.fp == roots.node, "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    least = group.groupBy("root").agg(F.min("first").alias("component_id"))
    named = group.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their group; of rows that repeat a doc_id one stays.

    Documents without words stay apart from each other here (each is kept): they share a fingerprint, not content.
    Rows without a doc_id stay.  All columns are kept as they are.
    """
    return first_of_groups(docs, near_duplicates(docs, shingle_words, max_bits))


def first_of_groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``keep_one`` with groups found before: doc_id, fp (0 without words) and component_id for each row of ``docs``.

    Rows with null, empty or wordless text and rows without a doc_id all stay; an empty table stays empty.
    """
    keep = (
        found.where(F.col("doc_id").isNotNull() & ((F.col("doc_id") == F.col("component_id")) | (F.col("fp") == 0)))
        .select(F.col("doc_id").alias("_keep"))
        .distinct()
    )
    kept = docs.join(keep, docs["doc_id"].cast("long") == keep["_keep"], "left_semi")
    # Of rows that repeat a doc_id the one whose values hash lowest, whatever the order of rows.
    repeated = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("_again"))
    again = cut(repeated)
    if not again.isEmpty():
        plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        more = kept.join(again, kept["doc_id"].cast("long") == again["_again"], "left_semi").select("doc_id", F.struct(*docs.columns).alias("_row"), F.xxhash64(*plain).alias("_h"))
        once = more.groupBy("doc_id").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
        kept = kept.join(again, kept["doc_id"].cast("long") == again["_again"], "left_anti").unionByName(once)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
