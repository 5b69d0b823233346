"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Pairs join documents of quality 1 with ones of quality 0, and documents of quality 1 with a copy of themselves whose words
are random letters, so that the model knows words from noise even if no labelled document is noise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witness.llm.common import cut
from witness.llm.quality_rules import _SPACES, _SYMBOLS, _repeat_words

#: Labelled documents to learn from, at most, by the hash of their doc_id; and pairs of them, at most.
SAMPLE_DOCS = 12_000
MAX_PAIRS = 20_000
THRESHOLD = 0.3
RIDGE = 1e-4
_PUNCT = b"!?.,;:|*#$%&<>@=_-+/()[]{}0123456789"
#: The last feature tells known words.
N_FEATURES = 15 + 2 * len(_PUNCT)
#: Buckets of hashed words, as bits of a broadcast map, and in how many labelled documents of quality 1 a known word is.
WORD_BUCKETS = 1 << 22
MIN_WORD_DOCS = 3
#: Words that a text seems to have besides its own, known like those of an average one: short texts tell little.
_PRIOR_WORDS = 5
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalpha())
_RUN = re.compile(r"[^\W\d_A-Z]+")
_LETTERS = "bcdfghjklmnpqrstvwxz"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Bucket of each word that has a letter: without marks round it and in lower case."""
    bare = (w.strip(_MARKS).lower() for w in words)
    return np.fromiter((crc32(w) for w in bare if w), np.int64) & (WORD_BUCKETS - 1)


@dataclass
class KnownWords:
    """Which buckets hold words of good documents, and the usual share of a good document's words that are known."""

    bits: np.ndarray
    usual: float

    @classmethod
    def none(cls) -> KnownWords:
        return cls(np.zeros(WORD_BUCKETS // 8, np.uint8), 0.0)

    def share(self, words: list[bytes]) -> float:
        at = word_buckets(words)
        known = int((self.bits[at >> 3] >> (at & 7) & 1).sum())
        return (known + _PRIOR_WORDS * self.usual) / (len(at) + _PRIOR_WORDS)

    def told(self, words: list[bytes]) -> float:
        """0 to 3: the share of known words, full from half of the usual share on, as texts differ in their subjects."""
        return 3 * min(1.0, self.share(words) / (0.5 * self.usual)) if self.usual else 3.0


def scrambled(text: str, seed: int) -> str:
    """The text with random consonants for the letters of its lower-case words."""
    rng = np.random.default_rng(seed)
    return _RUN.sub(lambda m: "".join(_LETTERS[k] for k in rng.integers(0, len(_LETTERS), len(m[0]))), text)


def features(text: str | None, known: KnownWords) -> np.ndarray:
    """Length-free statistics of the whole text, its marks and its words; all zero for null and wordless texts, but for
    the last, which takes them for known."""
    out = np.zeros(N_FEATURES)
    out[-1] = 3.0
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return out
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    total = len(data) - count[list(_SPACES)].sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeats, distinct = _repeat_words(words)
    alike = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
    upper, lower = count[65:91].sum(), count[97:123].sum()
    lines = text.split("\n")
    symbols = count[list(_SYMBOLS)].sum()
    share = np.array([upper / (upper + lower + 1), repeats / n, alike / n, 1 - distinct / n, symbols / n, symbols / total,
                      1 - len(set(lines)) / len(lines), (lengths <= 1).mean(), (lengths > 20).mean()])
    out[:9] = np.sqrt(share)
    out[9:14] = (np.log1p(n) / 10, lengths.mean() / 10, lengths.std() / 10, n / max(len(lines), 1) / 100, 1.0 / n)
    marks = count[list(_PUNCT)] / n
    out[14:-1] = np.r_[np.sqrt(marks), marks > 0.02]
    out[-1] = known.told(words)
    return np.clip(out, 0, 3)


def fit(x: np.ndarray, good: np.ndarray, max_pairs: int = MAX_PAIRS, seed: int = 5, against: np.ndarray | None = None) -> np.ndarray:
    """Weights of a Bradley-Terry model: P(a before b) = sigmoid(w . (a - b)), by Newton steps on the logistic loss.

    Pairs join each document of one quality with ones of the other in shuffled rounds; ``against`` has rows that those of
    quality 1 come before, each of its own.
    """
    rng = np.random.default_rng(seed)
    plus, minus = np.flatnonzero(good), np.flatnonzero(~good)
    w = np.zeros(x.shape[1])
    if not len(plus) or not len(minus):
        return w
    n = min(max_pairs, 20 * max(len(plus), len(minus)))
    deal = lambda part: np.concatenate([rng.permutation(part) for _ in range(-(-n // len(part)))])[:n]
    diff = x[deal(plus)] - x[deal(minus)]
    if against is not None:
        own = (x[plus] - against[plus])[:max_pairs]
        diff = np.concatenate([diff, own])
        n = len(diff)
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        slope = diff.T @ (1 - p) / n - RIDGE * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


def calibrate(raw: np.ndarray, good: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Shift and scale with which sigmoid(scale * (raw - shift)) is ``threshold`` at the raw score's quantile that
    rejects as many of the training documents as have quality 0; moved to the middle of the gap around it."""
    ordered = np.sort(raw)
    bad = int((~good).sum())
    if bad in (0, len(raw)):
        return float(ordered[0]) - 1.0, 1.0
    # Of the quantiles near the share of quality 0, the one with the fewest errors.
    near = np.unique(np.clip(np.round(np.linspace(0.8, 1.2, 81) * bad).astype(int), 1, len(raw) - 1))
    cuts = (ordered[near - 1] + ordered[near]) / 2
    errors = [((raw < c) & good).sum() + ((raw >= c) & ~good).sum() for c in cuts]
    best = np.flatnonzero(np.array(errors) == min(errors))
    limit = float(cuts[best[len(best) // 2]])
    scale = 1 / max(float(np.std(raw)) / 2, 1e-9)
    return limit - float(np.log(threshold / (1 - threshold))) / scale, scale


@dataclass
class Model:
    """Weights, and shift and scale of the scores."""

    w: np.ndarray
    shift: float
    scale: float
    known: KnownWords

    def score(self, texts: Iterator[str | None]) -> np.ndarray:
        raw = np.array([features(t, self.known) @ self.w for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw - self.shift), -30, 30)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in 0 to 1 for each row of ``docs``; only its text decides."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sent.value.score(t.as_py() for t in batch["text"]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def known_words(rows: DataFrame) -> KnownWords:
    """Of labelled documents (_id, _q, text) the words that ``MIN_WORD_DOCS`` good ones or more have."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"]:
                found = np.unique(word_buckets((text.as_py() or "").encode("utf-8", "surrogatepass").split()))
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["bucket"])

    good = rows.where("_q = 1").select("text").mapInArrow(split, "bucket long")
    often = good.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_WORD_DOCS).select("bucket")
    bits = np.zeros(WORD_BUCKETS, np.uint8)
    bits[often.toArrow()["bucket"].to_numpy()] = 1  # a number for each bucket, at most
    return KnownWords(np.packbits(bits, bitorder="little"), 0.0)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> Model:
    """The model of at most ``sample_docs`` labelled documents that aren't held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_q")).where("_q in (0, 1)")
    marks = marks.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_q").alias("_q"))
    # Labels for which there is a document, then a sample of them; its size is bounded, so it is broadcast.
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    chosen = marks.join(ids, "_id").orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    # Of different texts under one id the first by its hash.
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    rows = cut(rows.groupBy("_id", "_q").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    known = known_words(rows)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.share(t.as_py().encode("utf-8", "surrogatepass").split()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["share"])

    usual = rows.where("_q = 1 and text is not null").select("text").mapInArrow(share, "share double").agg(F.median("share")).first()[0]
    known.usual = usual or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch["text"]]
            own = [features(t, known).tolist() for t in texts]
            noise = [features(scrambled(t or "", i % 2**32), known).tolist() for t, i in zip(texts, batch["_id"].to_pylist(), strict=True)]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_q"], pa.array(own, kind), pa.array(noise, kind)], ["_id", "_q", "x", "noise"])

    found = rows.select("_id", F.col("_q").cast("int"), "text").mapInArrow(run, "_id long, _q int, x array<double>, noise array<double>").toArrow().sort_by("_id")
    if not len(found):
        return Model(np.zeros(N_FEATURES), 0.0, 1.0, known)
    # As columns: rows would be an object for each number, here and in the JVM.
    x, noise = (found[c].combine_chunks().flatten().to_numpy().reshape(len(found), -1) for c in ("x", "noise"))
    good = found["_q"].to_numpy() == 1
    w = fit(x, good, against=noise)
    return Model(w, *calibrate(x @ w, good, threshold), known)


def rank(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Learns from rows with a label that aren't held out (CRC-32 of the doc_id's digits, modulo 5, is 0).  ``predicted``
    is 1 where the score reaches ``threshold``, which stands at the quantile of raw scores that parts off as large a
    share as has quality 0.  Null, empty and wordless texts are scored as texts without any mark.  Without labels of
    both kinds all are predicted 1.  Labels may be null or lack a document; of labels for one document the lower one
    counts, and of different texts under one doc_id one by its hash.  Words in a language or subject of which few labelled
    documents are look unknown.  Rows repeat as in ``docs``; no
    other column is used.
    """
    return scores(docs, learn(docs, labels, sample_docs, threshold)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``rank`` predicts 1, columns as they are; scored in place, without a join.

    Null, empty and wordless texts stay or go together, by their score; repeated rows and null ids are rows like any
    other, and an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **options))
    threshold = options.get("threshold", THRESHOLD)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(text))

    return docs.where(score("text") >= threshold)
