"""Source divergence audit: how far each source's use of its language's terms lies from the other sources'.

Occurrences are counted by sorting pointers to word starts: each shard of documents is one byte buffer, its pointers are
put in order by multikey quicksort, and runs of equal words give document frequencies and counts by source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from witness.llm.common import cut

MIN_DOCS = 30
TOP_TERMS = 50
#: Added to every count, and what shares are told in.
PRIOR, UNIT = 5, 1_000_000_000
#: Terms of a block, about: a task holds a block's shares of all sources of one language.
BLOCK_TERMS = 512
#: Bytes of a buffer whose pointers are sorted at once.
_SHARD = 8 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of terms: ASCII letters and whatever isn't ASCII.
_IN_TERM = (_BYTES >= 128) | ((_LOWER >= 97) & (_LOWER <= 122))
#: The first n bytes of an eight-byte character.
_FIRST = np.array([0, *((2**64 - 1) << (64 - 8 * n) & (2**64 - 1) for n in range(1, 9))], np.uint64)

#: The same as DuckDB SQL over a table of documents.
ORACLE = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM {docs}),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 30),
seen AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) GROUP BY 1, 2, 3),
own AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN seen s USING (lang, source, term)),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM own JOIN size USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM own GROUP BY 1, 2) JOIN size USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) z
  ON z.lang = a.lang AND z.s = a.source AND z.t = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 50
"""


def pointers(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the terms in lower-cased bytes; ``first`` marks bytes that begin a document."""
    inside = _IN_TERM[data]
    joined = np.zeros(len(data) + 1, bool)  # byte k goes on a term of byte k - 1
    joined[1:-1] = inside[1:] & inside[:-1] & ~first[1:]
    starts = np.flatnonzero(inside & ~joined[:-1])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    return starts, ends - starts


def sort_pointers(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their words, and which of them begin a run of equal words.

    Multikey quicksort with characters of eight bytes: slices of pointers that agree so far are sorted by their next
    character, and the runs in them that agree in it too, and go on, are the slices of the next depth.  Words hold no
    zero byte, so that a character with zeros is a word's last.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chars = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
    order, first = np.arange(len(starts)), np.zeros(len(starts), bool)
    at, depth = np.arange(len(starts)), 0
    while len(at):
        own = order[at]
        left = np.clip(lens[own] - depth, 0, 8)
        char = chars[np.minimum(starts[own] + depth, len(data))].astype(np.uint64) & _FIRST[left]
        part = np.cumsum(first[at])
        by = np.lexsort((char, part)) if depth else np.argsort(char, kind="quicksort")
        order[at], char = own[by], char[by]
        new = np.ones(len(at), bool)
        new[1:] = (part[1:] != part[:-1]) | (char[1:] != char[:-1])
        first[at] = new
        run = np.cumsum(new) - 1
        more = (np.bincount(run) > 1)[run] & (char & np.uint64(255) > 0)
        at, depth = at[more], depth + 8
    return order, first


def _shards(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
    """(low row, high row, low byte, high byte, whole): documents by about ``_SHARD`` bytes; longer ones in pieces that
    end between terms, of which only ``whole`` shards hold whole documents."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SHARD, "right")) - 1)
        if end > row + 1 or offsets[end] - offsets[row] <= _SHARD:
            yield row, end, int(offsets[row]), int(offsets[end]), True
        else:
            lo, stop = int(offsets[row]), int(offsets[end])
            while lo < stop:
                hi = min(lo + _SHARD, stop)
                while hi < stop and _IN_TERM[data[hi]]:
                    gap = np.flatnonzero(~_IN_TERM[data[hi : min(hi + _SHARD, stop)]])
                    hi = hi + int(gap[0]) if len(gap) else min(hi + _SHARD, stop)
                yield row, end, lo, hi, False
                lo = hi
        row = end


def _count(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of one shard; ``offsets`` part its bytes by documents of ``group``."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    starts, lens = pointers(data, first[:-1])
    if not len(starts):
        return [], *(np.zeros(0, np.int64) for _ in range(3))
    order, new = sort_pointers(data, starts, lens)
    doc = np.searchsorted(offsets, starts[order], "right") - 1
    run = np.cumsum(new) - 1
    # Documents of a run, then its groups; a document is in one group.
    key = np.sort(run * np.int64(len(group)) + doc)
    pair_at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pair, n = key[pair_at], np.diff(np.append(pair_at, len(key)))
    n_groups = int(group.max()) + 1
    cell = pair // len(group) * n_groups + group[pair % len(group)]
    by = np.argsort(cell, kind="stable")
    cell, n = cell[by], n[by]
    cell_at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    head = order[np.flatnonzero(new)]
    raw = data.tobytes()
    words = [raw[s : s + k] for s, k in zip(starts[head].tolist(), lens[head].tolist(), strict=True)]
    cells = cell[cell_at]
    return [words[r] for r in (cells // n_groups).tolist()], cells % n_groups, np.add.reduceat(n, cell_at), np.diff(np.append(cell_at, len(cell)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each shard by language and source; a row without a term for each language and source."""

    def out(terms: list[bytes], groups: np.ndarray, n: np.ndarray, docs: np.ndarray, names: list[tuple[str, str]]) -> pa.RecordBatch:
        column = lambda k: pa.array([names[g][k] for g in groups.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([column(0), column(1), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        text = batch["text"]
        if not len(text):
            continue
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = _LOWER[np.frombuffer(data, np.uint8)[: offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
        names: dict[tuple[str, str], int] = {}
        group = np.array([names.setdefault(x, len(names)) for x in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)])
        told = list(names)
        zero = np.zeros(len(told), np.int64)
        yield out([b""] * len(told), np.arange(len(told)), zero, zero, told)
        long: dict[bytes, int] = {}
        for row, end, lo, hi, whole in _shards(offsets, data):
            own = np.clip(offsets[row : end + 1], lo, hi) - lo
            terms, groups, n, docs = _count(data[lo:hi], own, group[row:end])
            if whole:
                yield out(terms, groups, n, docs, told)
                continue
            for t, k in zip(terms, n.tolist(), strict=True):
                long[t] = long.get(t, 0) + k
            if hi == offsets[end]:
                yield out(list(long), np.full(len(long), group[row]), np.array(list(long.values()), np.int64), np.ones(len(long), np.int64), told)
                long = {}


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term; the empty term stands for the group itself."""
    seen = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = seen.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * v)), exactly; for ``v`` above zero."""
    return F.expr(f"1L + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + {PRIOR} AS DECIMAL(20,0))) div CAST({total} + {PRIOR} * v AS DECIMAL(20,0))")


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of a language's terms: for each two sources the sum of the differences of their shares.

    Rows without a term name the sources and the share of a term that they don't have.
    """
    sources = rows[rows.term == ""].reset_index(drop=True)
    own = rows[rows.term != ""]
    terms = {t: k for k, t in enumerate(own.term.unique())}
    lines = {s: k for k, s in enumerate(sources.source)}
    p = np.repeat(sources.p.to_numpy(np.int64)[:, None], len(terms), 1)
    p[own.source.map(lines).to_numpy(np.int64), own.term.map(terms).to_numpy(np.int64)] = own.p.to_numpy(np.int64)
    n = len(lines)
    value = np.concatenate([np.abs(p - line).sum(1) for line in p]) if n else np.zeros(0, np.int64)
    one, two = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    names = sources.source.to_numpy(object)
    other = one != two
    return pd.DataFrame({"lang": rows.lang.iloc[0], "source": names[one[other]], "item": names[two[other]], "value": value[other]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) its distance from every other source of the
    language (part ``pair``), and the terms that it uses most beyond the language's share (part ``term``).

    Terms are runs of ASCII letters and other than ASCII characters, of which only A-Z are lower-cased; a language keeps
    those in ``min_docs`` or more of its rows.  Null text, language and source are read as empty.  Rows count each, even
    if repeated.  A language that keeps no term has pairs of value 0.  An empty table gives no rows.  All arithmetic is
    exact; ties rank by item.  Other columns are not read.
    """
    counted = cut(term_counts(docs))
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    own = cut(counted.join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = own.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = (
        counted.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(size, "lang", "left")
        .na.fill(0, ["total", "v", "lang_total"])
    )
    shares = own.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total"), "q": share("lang_n", "lang_total")})
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    term = ranked(shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))

    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS))
    lines = shares.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), blocks).alias("block"))
    absent = F.when(F.col("v") > 0, share("0", "total")).otherwise(0)
    heads = groups.select("lang", "source", F.lit("").alias("term"), absent.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    summed = (
        lines.unionByName(heads).groupBy("lang", "block").applyInPandas(_pairs, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    pair = ranked(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pair.unionByName(term.where(F.col("rank") <= top_terms))
