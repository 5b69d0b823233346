"""Repeated passages by a common-prefix interval tree over an enhanced suffix array, spread over the cluster.

One suffix array over a corpus does not fit a task, so suffixes are dealt out by content.  In every window of
``min_bytes`` bytes the smallest hash of a ``GRAM``-byte piece (the leftmost of equals) names the window's *anchor*: a
rule on the window's bytes alone, so equal windows have equal anchors at equal offsets, and all suffixes with a common
prefix of ``min_bytes`` meet in the group of one anchor.  The windows of one anchor start at neighbouring bytes; their
bytes together are its *context*.

* A group is an enhanced suffix array of its different contexts, each with the number of its copies.  The suffixes are
  sorted, the longest common prefixes of neighbours are scanned with a stack, and each prefix interval whose occurrences
  differ in the byte to the left is a maximal repeat within the context; a context with copies is an interval of its own
  unless a larger one holds it.  Repeats are given with all their occurrences, those in copies included.
* The tree of a group with one context is that context, if it has copies: it needs no bytes.
* Groups with very many different contexts are resolved by counting the digests of their windows in a shuffle.
* A context that comes again within its document is a repeat already: where only covered bytes are asked for, it goes on
  once, with its number, so that lines repeated over and over make few rows.

Longer repeats run through several contexts and come out as overlapping pieces; their union per document is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witness.llm.common import cut, drop_cut, parts, row_key

MIN_BYTES = 400
GRAM = 64
#: Different contexts of an anchor that one task sorts; beyond it, windows are counted instead.
MAX_CONTEXTS = 16_384
_STEP = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POS = np.uint64((1 << 20) - 1)


# ---------------------------------------------------------------- anchors


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _STEP + (1 << 14)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers()


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each ``gram``-byte piece."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _UP[: len(data)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * _DOWN[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by running minima from both ends of blocks."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, _MASK, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of documents that lie one after the other in ``data``, document i at offsets[i]:offsets[i + 1].

    Ordered by document and place.  Gives for each anchor: document, first window start within it, number of windows, distance of the anchor from the
    first start, anchor hash, and the digest of the context as two longs.
    """
    w = min_bytes - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    view = memoryview(data)
    digest = xxhash.xxh3_128_digest
    for at in range(int(offsets[0]), int(offsets[-1]) - min_bytes + 1, _STEP):
        some = data[at : min(at + _STEP + min_bytes - 1, int(offsets[-1]))]
        h = _gram_hashes(some, gram)
        place = (_sliding_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), w) & _POS).astype(np.int64)
        turns = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1]
        first = max(int(np.searchsorted(offsets, at, "right")) - 1, 0)
        last = int(np.searchsorted(offsets, at + len(place), "left"))
        own = np.arange(first, last)
        lo = np.maximum(offsets[own] - at, 0)
        hi = np.minimum(offsets[own + 1] - at - min_bytes + 1, len(place))
        own, lo, hi = own[lo < hi], lo[lo < hi], hi[lo < hi]
        if not len(own):
            continue
        starts = np.unique(np.r_[turns, lo])
        doc = np.searchsorted(lo, starts, "right") - 1
        ends = np.r_[starts[1:], len(place)]
        ok = doc >= 0
        ok[ok] = starts[ok] < hi[doc[ok]]
        starts, doc, ends = starts[ok], doc[ok], ends[ok]
        n = np.minimum(ends, hi[doc]) - starts
        tops = (at + starts).tolist()
        raw = b"".join([digest(view[a:b]) for a, b in zip(tops, (at + starts + n - 1 + min_bytes).tolist(), strict=True)])
        both = np.frombuffer(raw, "<i8").reshape(-1, 2)
        p = place[starts]
        out.append((own[doc], at + starts - offsets[own[doc]], n, p - starts, h[p].view(np.int64), both[:, 0], both[:, 1]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.fill_null("") if column.null_count else column
    _, where, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


# ---------------------------------------------------------------- the interval tree of one group


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each prefix interval of at least ``least``; lcp[i] is that of suffixes i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = (lcp[i] if i < len(lcp) else 0), i - 1
        while now < stack[-1][0]:
            length, left = stack.pop()
            if length >= least:
                yield length, left, i - 1
        if now > stack[-1][0]:
            stack.append((now, left))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def group_repeats(
    contexts: list[bytes], anchor: np.ndarray, n: np.ndarray, min_bytes: int, copies: list[int] | None = None
) -> list[tuple[int, int, int, int]]:
    """Maximal repeats among the different contexts of one anchor: (repeat, context, start in it, length).

    ``anchor`` is the anchor's distance from each context's start, ``n`` the number of suffixes of each, ``copies`` how
    often each occurs (once by default).  ``repeat`` numbers the repeats of the group.
    """
    out: list[tuple[int, int, int, int]] = []
    d, most = len(contexts), int(anchor.max())
    first = most - anchor  # column of each context's first byte when anchors stand in one column
    starts = int((first + n).max())
    width = starts + min_bytes
    m = np.zeros((d, width), np.uint8)
    for i, c in enumerate(contexts):
        m[i, first[i] : first[i] + len(c)] = np.frombuffer(c, np.uint8)
    coin = np.random.default_rng(97).integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)
    found = 0
    step = max(1, min(starts, (1 << 21) // (8 * d * 8)))
    rows = np.arange(d, dtype=np.uint64)
    roll = (m[:, :min_bytes] * coin[:min_bytes]).sum(1, dtype=np.uint64)
    for at in range(0, starts, step):
        cols = np.arange(at, min(at + step, starts))
        # Hash of the window at each column: a random coefficient for each column, so compared within a column only.
        gain = m[:, cols + min_bytes].astype(np.uint64) * coin[cols + min_bytes]
        move = gain - m[:, cols].astype(np.uint64) * coin[cols]
        ahead = roll[:, None] + np.cumsum(move, 1, dtype=np.uint64)
        h = np.concatenate([roll[:, None], ahead[:, :-1]], 1)
        roll = ahead[:, -1]
        inside = (cols >= first[:, None]) & (cols < (first + n)[:, None])
        h = np.where(inside, h, rows[:, None])
        order = np.sort(h, axis=0)
        same = (order[1:] == order[:-1]).sum(0)
        if not same.any():
            continue
        # With the byte to the left (unknown at a context's start) some equal pairs part: those repeats extend no further.
        before = np.where((cols > first[:, None]), m[:, np.maximum(cols - 1, 0)].astype(np.uint64) + np.uint64(1), rows[:, None] + np.uint64(300))
        order = np.sort(h * np.uint64(3) + before * np.uint64(0xC2B2AE3D27D4EB4F), axis=0)
        for k in np.flatnonzero(same > (order[1:] == order[:-1]).sum(0)):
            value, count = np.unique(h[:, k], return_counts=True)
            member = np.flatnonzero(np.isin(h[:, k], value[count > 1]) & inside[:, k]).tolist()
            c = int(cols[k])
            suffix = {i: contexts[i][c - int(first[i]) :] for i in member}
            array = sorted(member, key=suffix.__getitem__)
            lcp = [0] + [_common(suffix[a], suffix[b]) for a, b in zip(array, array[1:], strict=False)]
            for length, a, b in prefix_intervals(lcp, min_bytes):
                part = array[a : b + 1]
                if len({int(before[i, k]) for i in part}) > 1:
                    out += [(found, i, c - int(first[i]), length) for i in part]
                    found += 1
    # Copies of a context are neighbours in the suffix array, with all of it in common.
    held = {i for _, i, start, length in out if not start and length == len(contexts[i])}
    for i in range(d):
        if copies and copies[i] > 1 and i not in held:
            out.append((found, i, 0, len(contexts[i])))
            found += 1
    return out


# ---------------------------------------------------------------- the operator


def maximal_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int | None = None, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """_id, _th, start, length, anchor, repeat: every occurrence of every maximal repeat of ``min_bytes`` or more.

    Occurrences of one repeat have the same (anchor, repeat); ``_id`` and ``_th`` are as in ``row_key``.  A repeat that
    runs over several anchors comes in overlapping pieces.  Rows that repeat both doc_id and text count as documents of
    their own.  Null and short texts, and empty tables, have no repeats.
    """
    return _occurrences(docs, min_bytes, gram or min(GRAM, min_bytes // 2), max_contexts, True)


def _occurrences(docs: DataFrame, min_bytes: int, gram: int, max_contexts: int, listed: bool) -> DataFrame:
    """As ``maximal_repeats``; unless ``listed``, overlapping pieces of a context are one row without a repeat's name."""
    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _utf8(batch["text"])
            found = anchors(data, offsets, min_bytes, gram)
            spans, times = _within(found, min_bytes, not listed)
            for some in (spans, (*found, times)) if not listed else ((*found, times),):
                doc, lo, n, p, anchor, c1, c2, times = some
                keep = np.flatnonzero(times)
                doc = pa.array(doc[keep])
                cols = [x[keep] for x in (lo, n, p.astype(np.int32), anchor, c1, c2, times)]
                yield pa.RecordBatch.from_arrays([batch["_id"].take(doc), batch["_th"].take(doc), *map(pa.array, cols)], ["_id", "_th", "lo", "n", "p", "anchor", "c1", "c2", "times"])

    keyed = docs.select(*row_key(docs), "text")
    every = cut(keyed.mapInArrow(find, "_id long, _th long, lo long, n long, p int, anchor long, c1 long, c2 long, times long"))
    # Rows with negative times are spans that repeat within their document.
    known = every.where("times < 0").select("_id", "_th", F.col("lo").alias("start"), F.col("n").alias("length"), F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("string").alias("repeat"))
    # Written first, so that the join below has plain shuffles on both sides, which AQE can split where a key is hot.
    repeated = cut(
        every.where("times > 0").groupBy("anchor")
        .agg(F.sum("times").alias("all"), (F.min("c1") != F.max("c1")).alias("mixed"))
        .where("all > 1")
    )
    some = cut(every.where("times > 0").join(repeated.select("anchor", "mixed"), "anchor"))
    contexts = cut(
        some.groupBy("anchor", "c1", "c2")
        .agg(F.sum("times").alias("copies"), F.first("mixed").alias("mixed"), F.min(F.struct("_id", "_th", "lo", "n", "p")).alias("one"))
    )
    as_whole = (F.lit(0).cast("long").alias("start"), (F.col("n") - 1 + min_bytes).cast("long").alias("length"), F.concat_ws(":", F.lit("w"), "c1", "c2").alias("repeat"))
    whole = contexts.where("copies > 1 and not mixed").select("anchor", "c1", "c2", F.col("one.n").alias("n")).select("anchor", "c1", "c2", *as_whole)
    mixed = contexts.where("mixed").select("anchor", "c1", "c2", "copies", "one.*")
    sizes = cut(mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")))
    wanted = (
        mixed.join(sizes, "anchor")
        .groupBy("_id", "_th")
        .agg(F.collect_list(F.struct("anchor", "c1", "c2", "lo", "n", "p", "different", "copies")).alias("want"))
    )
    read = keyed.join(wanted, ["_id", "_th"])
    pieces = cut(
        read.mapInArrow(_slicer(min_bytes), "anchor long, c1 long, c2 long, n long, p int, different long, copies long, context binary")
    )
    usual = (
        pieces.where(F.col("different") <= max_contexts)
        .repartition(parts(spark), "anchor")
        .sortWithinPartitions("anchor", "c1", "c2")
        .mapInArrow(_grouper(min_bytes, listed), "anchor long, c1 long, c2 long, start long, length long, repeat string")
    )
    found = whole.unionByName(usual)
    crowded = pieces.where(F.col("different") > max_contexts)
    if not crowded.isEmpty():
        copied = crowded.where("copies > 1").select("anchor", "c1", "c2", "n").distinct().select("anchor", "c1", "c2", *as_whole)
        counted = _counted(crowded, min_bytes)
        if not listed:
            counted = counted.join(copied.select("anchor", "c1", "c2"), ["anchor", "c1", "c2"], "left_anti")
        found = found.unionByName(counted).unionByName(copied)
    across = (
        some.select("_id", "_th", "lo", "anchor", "c1", "c2")
        .join(found, ["anchor", "c1", "c2"])
        .select("_id", "_th", (F.col("lo") + F.col("start")).alias("start"), "length", "anchor", "repeat")
    )
    return across if listed else across.unionByName(known)


def _within(found: tuple[np.ndarray, ...], min_bytes: int, merge: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Spans of contexts that come again within their document, overlapping ones as one, and how often each context goes
    on: all its times with its first occurrence, 0 for the others; every one once unless ``merge``."""
    doc, lo, n, p, anchor, c1, c2 = found
    times = np.ones(len(doc), np.int64)
    none = np.zeros(0, np.int64)
    if not merge or not len(doc):
        return (none,) * 8, times
    order = np.lexsort((lo, c2, c1, anchor, doc))
    key = np.stack([doc, anchor, c1, c2])[:, order]
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
    count = np.diff(np.r_[starts, len(order)])
    times[:] = 0
    times[order[starts]] = count
    again = np.sort(order[np.repeat(count > 1, count)])  # by document and place
    if not len(again):
        return (none,) * 8, times
    d, a = doc[again], lo[again]
    b = a + n[again] - 1 + min_bytes
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] > b[:-1])])  # ends grow with starts
    last = np.r_[new[1:], len(again)] - 1
    zero = np.zeros(len(new), np.int64)
    return (d[new], a[new], b[last] - a[new], zero, zero, zero, zero, zero - 1), times


def _slicer(min_bytes: int):
    """Cuts the wanted contexts out of the texts; of rows alike in id and text, which the join brings together, the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for one, two, text, want in zip(batch["_id"], batch["_th"], batch["text"], batch["want"], strict=True):
                own = one.as_py(), two.as_py()
                if own == before:
                    continue
                before = own
                data = (text.as_py() or "").encode()
                want = want.values.flatten()
                anchor, c1, c2, lo, n, p, different, copies = want
                cuts = [data[a : a + k - 1 + min_bytes] for a, k in zip(lo.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, c1, c2, n, p, different, copies, pa.array(cuts, pa.binary())], ["anchor", "c1", "c2", "n", "p", "different", "copies", "context"])

    return run


def _grouper(min_bytes: int, listed: bool):
    """Streams the contexts of a partition, sorted by anchor, and resolves one anchor after the other."""
    names = ["anchor", "c1", "c2", "start", "length", "repeat"]

    def resolve(rows: list[tuple]) -> list[tuple]:
        kept = []
        for r in rows:  # a context that came twice, as the join split the rows that repeat a doc_id and text
            if not kept or r[1:3] != kept[-1][1:3]:
                kept.append(r)
        if len(kept) < 2:
            return []
        got = group_repeats([r[5] for r in kept], np.array([r[4] for r in kept]), np.array([r[3] for r in kept]), min_bytes, [r[6] for r in kept])
        if listed:
            return [(*kept[i][:3], start, length, f"m{k}") for k, i, start, length in got]
        spans: dict[int, list[tuple[int, int]]] = {}
        for _, i, start, length in got:
            spans.setdefault(i, []).append((start, start + length))
        return [(*kept[i][:3], a, b - a, None) for i, some in spans.items() for a, b in _merged(some)]

    def pack(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found: list[tuple] = []
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("anchor", "c1", "c2", "n", "p", "context", "copies")]
            for r in zip(*cols, strict=True):
                if rows and rows[-1][0] != r[0]:
                    found += resolve(rows)
                    rows = []
                rows.append(r)
            if found:
                yield pack(found)
                found = []
        found = resolve(rows) if rows else []
        if found:
            yield pack(found)

    return run


def _counted(pieces: DataFrame, min_bytes: int) -> DataFrame:
    """Repeats of exactly ``min_bytes`` between contexts of anchors that have too many, by counts of window digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, c1, c2, n, p, context in zip(*(batch[c].to_pylist() for c in ("anchor", "c1", "c2", "n", "p", "context")), strict=True):
                raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(context[k : k + min_bytes]) for k in range(n)]), "<i8").reshape(-1, 2)
                k = np.arange(n, dtype=np.int64)
                same = [pa.array(np.full(n, x, np.int64)) for x in (anchor, c1, c2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(k), pa.array(p - k), pa.array(raw[:, 0]), pa.array(raw[:, 1])], ["anchor", "c1", "c2", "start", "back", "w1", "w2"])

    windows = pieces.dropDuplicates(["anchor", "c1", "c2"]).mapInArrow(run, "anchor long, c1 long, c2 long, start long, back long, w1 long, w2 long")
    by = ["anchor", "back", "w1", "w2"]
    often = windows.groupBy(*by).count().where("count > 1").drop("count")
    return windows.join(often, by).select(
        "anchor", "c1", "c2", "start", F.lit(min_bytes).cast("long").alias("length"), F.concat_ws(":", F.lit("c"), "w1", "w2").alias("repeat")
    )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``docs`` with the text's repeated bytes taken out, and four columns more.

    A byte goes if it lies in a string of ``min_bytes`` bytes that starts anywhere else too, in the same or another
    row; strings are judged on the input.  ``kept_text`` is what remains (a null text stays null; UTF-8 sequences that
    a cut broke are dropped), ``kept_sha256`` the SHA-256 of the remaining bytes, unbroken or not; ``n_bytes``,
    ``n_removed`` and ``n_spans`` count the text's bytes, those removed and the maximal removed runs.  Columns of
    ``docs`` with these names are overwritten; every row comes back.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    kept = docs.drop(*new)
    spans = (
        _occurrences(docs, min_bytes, min(GRAM, min_bytes // 2), max_contexts, False)
        .groupBy("_id", "_th", "start")
        .agg(F.max("length").alias("length"))
        .groupBy("_id", "_th")
        .agg(F.collect_list(F.struct("start", "length")).alias("_spans"))
    )
    rows = kept.select("text", F.struct(*kept.columns).alias("_row"), *row_key(kept))
    keyed = rows.join(spans, ["_id", "_th"], "left").select("text", "_row", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts = [], []
            for text, spans in zip(batch["text"], batch["_spans"], strict=True):
                raw = text.as_py()
                data = (raw or "").encode()
                cuts = []
                if spans.is_valid and len(spans):
                    start, length = (x.to_pylist() for x in spans.values.flatten())
                    cuts = _merged([(a, a + n) for a, n in zip(start, length, strict=True)])
                at, left = 0, []
                for a, b in cuts:
                    left.append(data[at:a])
                    at = b
                left = b"".join([*left, data[at:]])
                counts.append((len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(left).hexdigest()))
                texts.append(None if raw is None else raw if not cuts else left.decode("utf-8", "ignore"))
            cols = list(zip(*counts, strict=True)) or [[]] * 4
            arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch["_row"], *arrays], ["_row", *new])

    schema = keyed.select("_row").schema
    for name, kind in zip(new, ("long", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    return keyed.mapInArrow(run, schema).select("_row.*", *new)


def rewrite(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with repeated passages cut out of text, and n_chars, where there is one, counted anew; nothing else changes."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    found = remove_repeats(rows, min_bytes)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
