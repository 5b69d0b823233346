"""LM scoring by cross-entropy difference: a target and a background character n-gram model over one vocabulary.

Tokens are code points.  Both models count the same n-grams of all documents (the background) and of those marked as
target, are smoothed alike, each order towards the next shorter one, and the background's counts are scaled to the
target's size, so that the models are matched in all but their texts.  Counts of n-grams come together by a shuffle in
which each task sends an n-gram once; the table grows with what the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witness.llm.common import cut

ORDER = 4
#: Strength of the shorter order in each estimate, in counts.
PRIOR = 20.0
#: N-grams that may be broadcast; a larger model is dealt to slices of documents by a join.
MAX_BROADCAST = 2_000_000
SLICE_DOCS = 2_000
_CHUNK = 1 << 20
_START = 2  # stands before each text, so that every token has a whole context


def _chunks(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of neighbouring texts with ORDER - 1 starts before each; and the number and length of each text.

    A long text comes in several chunks, each with the context it needs: then it has a row in each.
    """
    some: list[np.ndarray] = []
    who: list[int] = []
    size: list[int] = []
    total = 0
    pad = np.full(ORDER - 1, _START, np.uint32)
    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        before = pad
        for at in range(0, max(len(points), 1), _CHUNK):
            part = points[at : at + _CHUNK]
            some += [before, part]
            who.append(i)
            size.append(len(part))
            total += len(part)
            before = part[-(ORDER - 1) :] if len(part) >= ORDER - 1 else pad
            if total >= _CHUNK:
                yield np.concatenate(some), np.array(who), np.array(size)
                some, who, size, total = [], [], [], 0
    if some:
        yield np.concatenate(some), np.array(who), np.array(size)


def _number(ids: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """The same values numbered from 0 without gaps, and how many there are."""
    if bound <= max(4 * len(ids), 1 << 22):
        seen = np.zeros(bound, bool)
        seen[ids] = True
        dense = np.cumsum(seen) - 1
        return dense[ids], int(dense[-1]) + 1 if bound else 0
    values, dense = np.unique(ids, return_inverse=True)
    return dense, len(values)


def _orders(points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places of the real tokens, and for each order the n-gram number at each and one place of each n-gram."""
    ends = np.cumsum(size + ORDER - 1)
    real = np.ones(len(points), bool)
    for k in range(ORDER - 1):
        real[ends - size - 1 - k] = False
    places = np.flatnonzero(real)
    char, width = _number(points.astype(np.int64), int(points.max()) + 1 if len(points) else 0)
    out, ids, n = [], char[places], width
    for k in range(ORDER):
        if k:
            ids, n = _number(ids * width + char[places - k], n * width)
        one = np.zeros(n, np.int64)
        one[ids] = places
        if not k:  # numbers of start signs have no place
            ids, n = _number(ids, n)
            one = np.zeros(n, np.int64)
            one[ids] = places
        out.append((ids, one))
    return places, out


def _keys(points: np.ndarray, places: np.ndarray, order: int, back: int = 0) -> np.ndarray:
    """64-bit hash of the ``order`` tokens that end ``back`` before each place."""
    h = np.full(len(places), 0x51ED270B + order, np.uint64)
    for k in range(order):
        h ^= points[places - back - k].astype(np.uint64) + np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """order, gram, context, shorter, target, background: counts of each n-gram of orders 1 to ORDER.

    ``docs`` has text and a boolean ``_target``.  ``context`` is the n-gram without its last token, ``shorter``
    without its first.
    """
    schema = "order int, gram long, context long, shorter long, target long, background long"
    names = ["order", "gram", "context", "shorter", "target", "background"]

    def merge(held: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(held, 1)
        _, first, back = np.unique(rows[1], return_index=True, return_inverse=True)
        out = rows[:, first]
        out[4] = np.bincount(back, rows[4], len(first))
        out[5] = np.bincount(back, rows[5], len(first))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            wanted = np.array(batch["_target"].to_pylist(), bool)
            for points, who, size in _chunks(t.as_py() for t in batch["text"]):
                places, orders = _orders(points, size)
                target = np.repeat(wanted[who], size)
                for k, (ids, one) in enumerate(orders, 1):
                    n = len(one)
                    held.append(np.stack([np.full(n, k), _keys(points, one, k), _keys(points, one, k - 1, 1), _keys(points, one, k - 1),
                                          np.bincount(ids[target], minlength=n), np.bincount(ids, minlength=n)]))
                if sum(x.shape[1] for x in held) > 2_000_000:
                    held = [merge(held)]
                    if held[0].shape[1] > 1_000_000:
                        yield _pack(held.pop(), names)
        if held:
            yield _pack(merge(held), names)

    sent = docs.select("text", "_target").mapInArrow(run, schema)
    return sent.groupBy("order", "gram").agg(
        F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("target").alias("target"), F.sum("background").alias("background")
    )


def _pack(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), *(pa.array(r.astype(np.int64)) for r in rows[1:])], names)


def model(grams: DataFrame, prior: float = PRIOR) -> DataFrame:
    """gram, lt, lb: log-probability of the last token of each ORDER-gram after the others, in both models."""
    one = grams.where("order = 1")
    all_of = one.agg(F.sum("target").alias("t"), F.sum("background").alias("b"), F.count(F.lit(1)).alias("v")).first()
    base = 1.0 / ((all_of.v or 0) + 1)  # one vocabulary: every token seen, and one for the rest
    scale = (all_of.t or 1) / (all_of.b or 1) if all_of.t else 1.0
    p = None
    for k in range(1, ORDER + 1):
        rows = grams.where(F.col("order") == k).withColumn("background", F.col("background") * scale)
        after = rows.groupBy("context").agg(F.sum("target").alias("nt"), F.sum("background").alias("nb"))
        rows = rows.join(after, "context")
        if p is None:
            rows = rows.withColumns({"pt": F.lit(base), "pb": F.lit(base)})
        else:
            rows = rows.join(p.withColumnRenamed("gram", "shorter"), "shorter")
        p = rows.select(
            "gram",
            ((F.col("target") + prior * F.col("pt")) / (F.col("nt") + prior)).alias("pt"),
            ((F.col("background") + prior * F.col("pb")) / (F.col("nb") + prior)).alias("pb"),
        )
    return p.select("gram", F.log("pt").alias("lt"), F.log("pb").alias("lb"))


def _losses(texts, grams: np.ndarray, lt: np.ndarray, lb: np.ndarray, n: int) -> np.ndarray:
    """Tokens, target and background loss of each of ``n`` texts; ``grams`` is sorted and holds all that they have."""
    out = np.zeros((3, n))
    for points, who, size in _chunks(texts):
        ids, one = _orders(points, size)[1][-1]
        at = np.searchsorted(grams, _keys(points, one, ORDER))
        out[0] += np.bincount(who, size, n)
        doc = np.repeat(who, size)
        out[1] -= np.bincount(doc, lt[at][ids], n)
        out[2] -= np.bincount(doc, lb[at][ids], n)
    return out


def _result(ids: pa.Array, losses: np.ndarray) -> list[pa.Array]:
    n, t, b = losses
    with np.errstate(invalid="ignore", divide="ignore"):
        each = [np.round(t / n, 9), np.round(b / n, 9)]
    none = n == 0
    return [ids, pa.array(n.astype(np.int64)), *(pa.array(x, pa.float64(), mask=none) for x in (*each, each[0] - each[1]))]


_SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_NAMES = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]


def score(docs: DataFrame, target_ids: DataFrame, max_broadcast: int = MAX_BROADCAST, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for each row of ``docs``.

    ``target_ids`` has the doc_id of the documents that the target model learns from; ids that repeat, are null or
    name no document don't matter.  Losses are nats per token over the whole text; ``score`` is target less
    background, so the lower, the more a text is like the target.  Null and empty texts have no tokens and null losses.
    Rows repeat as in ``docs``.  An empty table gives an empty result.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("_target", F.lit(True))
    # By shuffle at every size: ids of all target documents have no bound that a broadcast could rely on.
    marked = ids.join(wanted.hint("merge"), "doc_id", "left").withColumn("_target", F.coalesce("_target", F.lit(False)))
    grams = cut(count_grams(marked))
    table = cut(model(grams))
    if table.count() <= max_broadcast:
        rows = table.orderBy("gram").toPandas()  # its size was checked
        held = ids.sparkSession.sparkContext.broadcast([rows[c].to_numpy() for c in ("gram", "lt", "lb")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(_result(batch["doc_id"], _losses((t.as_py() for t in batch["text"]), *held.value, len(batch))), _NAMES)

        return ids.mapInArrow(run, _SCHEMA)
    return _score_slices(ids, table, slice_docs)


def _score_slices(ids: DataFrame, table: DataFrame, slice_docs: int) -> DataFrame:
    """The same for a model of any size: each slice of documents gets the n-grams that it has."""
    slices = max(1, ids.count() // slice_docs)
    sliced = ids.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)))

    def need(group: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)]
        for points, _, size in _chunks(t.as_py() for t in group["text"]):
            found.append(_keys(points, _orders(points, size)[1][-1][1], ORDER))
        keys = np.unique(np.concatenate(found))
        return pa.table({"slice": pa.array(np.full(len(keys), group["slice"][0].as_py())), "gram": pa.array(keys)})

    def lose(group: pa.Table, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["gram"].to_numpy())
        grams, lt, lb = (rows[c].to_numpy()[order] for c in ("gram", "lt", "lb"))
        losses = _losses((t.as_py() for t in group["text"]), grams, lt, lb, len(group))
        return pa.table(dict(zip(_NAMES, _result(group["doc_id"].combine_chunks(), losses), strict=True)))

    wanted = sliced.groupBy("slice").applyInArrow(need, "slice long, gram long").join(table, "gram").select("slice", "gram", "lt", "lb")
    return sliced.groupBy("slice").cogroup(wanted.groupBy("slice")).applyInArrow(lose, _SCHEMA)
