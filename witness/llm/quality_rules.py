"""Quality rules: rule statistics of whole texts, and an isolation forest over them calibrated by labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witness.llm.common import cut

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bangs", "n_distinct", "n_lines")
#: Statistics as rates, free of a text's length: what the trees split on.
RATES = ("symbols", "repeats", "upper", "bangs", "word_length", "distinct")
#: Labelled rows that the trees are grown on, at most; the threshold looks at all labelled rows.
SAMPLE_ROWS = 20_000
TREES = 200
TREE_ROWS = 128
#: Share of good labelled rows that the threshold may reject.
MAX_LOST = 0.005
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_STRIP = _SPACES.decode()


# ---------------------------------------------------------------- statistics


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a 3-word window found twice or more, and different words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    v = len(number)
    if len(ids) < 3 or v == len(ids):
        return 0, v
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # keep the product of three within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * v + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(window)] |= twice
    return int(hit.sum()), v


def _changed(data: bytes, low: bytes) -> int:
    """Bytes that lower-casing changes, about one for each capital; ASCII capitals where it also changes lengths."""
    x = np.frombuffer(data, np.uint8)
    return int(np.count_nonzero(x != np.frombuffer(low, np.uint8)) if len(data) == len(low) else ((x > 64) & (x < 91)).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text; all zero for null."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # on ASCII white space
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    spaces = int(count[list(_SPACES)].sum())
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(_STRIP):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeats, distinct = _repeat_words(words)
    low = text.lower().encode("utf-8", "surrogatepass")
    upper = 0 if low == data else _changed(data, low)
    letters = int(count[65:91].sum() + count[97:123].sum() + count[0xC3:0xF5].sum())  # lead bytes: other letters
    return (len(words), len(text) - spaces, int(count[list(_SYMBOLS)].sum()), dup, repeats, upper, letters, int(count[33] + count[63]), distinct, lines)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS for each row of ``docs``, from whole texts; null texts have none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(text_stats(t.as_py()) for t in batch["text"]), strict=True)) or [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *STATS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def rates(df: pd.DataFrame) -> np.ndarray:
    n = np.maximum(df.n_words.to_numpy(float), 1)
    letters = np.maximum(df.n_letters.to_numpy(float), 1)
    # Different words fall with length by themselves, so they count as a power of it.
    cols = (df.n_symbols / n, df.n_repeat_words / n, df.n_upper / letters, df.n_bangs / n, df.word_chars / n, np.log1p(df.n_distinct) / np.log1p(n))
    return np.stack([np.asarray(c, float) for c in cols], 1)


# ---------------------------------------------------------------- the forest


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: feature (-1 in a leaf), cut, left child (right is the next), path length of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / usual length): near 1 for what few random splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.cut[t][at]
                at = np.where(inner, self.left[t][at] + right, at)
            total += self.length[t][at]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    rows = min(tree_rows, len(x))
    limit = int(np.ceil(np.log2(max(rows, 2)))) + 4
    built = []
    for _ in range(trees):
        nodes: list[list[float]] = [[-1, 0, 0, 0]]
        todo = [(0, x[rng.choice(len(x), rows, replace=False)], 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            free = np.flatnonzero(high > low)
            if depth >= limit or len(part) < 2 or not len(free):
                nodes[at][3] = depth + _expected(len(part))
                continue
            f = int(rng.choice(free))
            c = float(rng.uniform(low[f], high[f]))
            c = c if c > low[f] else float(high[f])
            nodes[at][:3] = [f, c, len(nodes)]
            todo += [(len(nodes), part[part[:, f] < c], depth + 1), (len(nodes) + 1, part[part[:, f] >= c], depth + 1)]
            nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        built.append(np.array(nodes))
    most = max(map(len, built))
    flat = np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), constant_values=-1) for b in built])
    return Forest(flat[..., 0].astype(np.int64), flat[..., 1], flat[..., 2].astype(np.int64), flat[..., 3], _expected(rows))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_lost: float = MAX_LOST) -> DataFrame:
    """doc_id, STATS, base_failed, anomaly, kept for each row of ``docs``.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows.  The forest is grown on the
    rates of at most ``sample_rows`` labelled rows that pass the base rules, taken by the hash of their doc_id.  The
    threshold on its score is the one that tells labelled rows of quality 0 and 1 apart best (Youden's index over all
    labelled rows, in steps of 0.001), rejecting at most ``max_lost`` of those of quality 1.  Without labels of both
    kinds nothing is rejected but by the base rules.  Labels without a quality, or for no document, don't count; of
    labels for one document the lower one counts.
    Null, empty and wordless texts fail the base rules.  Rows repeat as in ``docs``.  Other columns are not looked at.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = cut(statistics(docs).withColumn("base_failed", base))
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_q")).where("_q in (0, 1)").groupBy("_id").agg(F.min("_q").alias("_q"))
    marked = known.where("not base_failed").join(marks, F.col("doc_id") == F.col("_id")).drop("_id")
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()
    if sample.empty:
        return known.withColumn("anomaly", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    forest = grow(rates(sample))

    @F.pandas_udf("double")
    def anomaly(*cols: pd.Series) -> pd.Series:
        df = pd.DataFrame(dict(zip(STATS, cols, strict=True)))
        return pd.Series(forest.score(rates(df)))

    score = anomaly(*STATS)
    steps = (
        marked.select(F.ceil(score * 1000).cast("int").alias("step"), "_q")
        .groupBy("step").agg(F.count_if(F.col("_q") == 1).alias("good"), F.count_if(F.col("_q") == 0).alias("bad"))
        .toPandas().sort_values("step", ascending=False)
    )
    limit = 1.0
    good, bad = steps.good.sum(), steps.bad.sum()
    if good and bad:
        lost, caught = steps.good.cumsum() / good, steps.bad.cumsum() / bad
        gain = (caught - lost).where(lost <= max_lost, -1.0)
        if gain.max() > 0:
            limit = (int(steps.step[gain.idxmax()]) - 1) / 1000
    return known.withColumn("anomaly", score).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= limit))
