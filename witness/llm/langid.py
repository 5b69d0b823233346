"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
#: Buckets of hashed n-grams: the broadcast matrix has BUCKETS rows and a column for each language.
BUCKETS = 1 << 16
#: Cells of that matrix, at most: with so many languages that it would have more, buckets are halved until it fits.
MODEL_CELLS = 1 << 24
#: Training documents, at most, taken by the hash of their doc_id.
SAMPLE_DOCS = 10_000
SMOOTHING = 0.5
UNKNOWN = "und"
_PIECE = 1 << 20
#: N-grams of a batch that are scored at a time, divided by the number of languages.
_CELLS = 1 << 22
_SALT = np.uint32(0x9E3779B1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, other characters than letters squeezed to one blank between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = ((points >= 97) & (points <= 122)) | (points >= 0xC0)
    out = np.where(plain, points, 32).astype(np.uint32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def grams(text: str, orders: tuple = ORDERS, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's n-grams, a bounded number at a time; each order's hash extends the one before."""
    shift = np.uint32(33 - int(buckets).bit_length())
    longest = max(orders)
    for at in range(0, max(len(text), 1), _PIECE):
        points = _points(" " + text[max(at - longest + 1, 0) : at + _PIECE] + " ")
        h = np.zeros(len(points) + 1, np.uint32)
        for n in range(1, min(longest, len(points)) + 1):
            h = (h[:-1] ^ points[n - 1 :]) * _SALT
            h ^= h >> np.uint32(15)
            if n in orders:
                yield (h * _SALT) >> shift


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, orders: tuple = ORDERS, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the matrix of their log-probabilities, with the log-priors in a last row.

    ``docs`` has text and lang.  Counts are taken in tasks and come to the driver as one packed row for each language;
    the sample bounds the documents, ``MODEL_CELLS`` the matrix.
    """
    # The hashes alone are ranked; texts stay where they are and are taken by the hash that the next row would have.
    usable = docs.where("text is not null and lang is not null").withColumn("_h", F.xxhash64("doc_id", "text"))
    edge = usable.select("_h").orderBy("_h").limit(sample_docs + 1).agg(F.count("_h").alias("n"), F.max("_h").alias("h")).first()
    sample = usable if edge.n <= sample_docs else usable.where(F.col("_h") < edge.h)
    n_langs = sample.select("lang").distinct().count()
    if not n_langs:
        return [], np.zeros((buckets + 1, 0), np.float32)
    while n_langs * buckets > MODEL_CELLS and buckets > 1 << 8:
        buckets //= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}  # at most MODEL_CELLS counts
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                own = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                own[buckets] += 1
                for g in grams(text.as_py(), orders, buckets):
                    if len(g) > buckets // 8:
                        own[:buckets] += np.bincount(g, minlength=buckets)
                    else:
                        np.add.at(own, g, 1)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch["found"]:
                own = np.zeros(buckets + 1, np.int64)
                at, n = found.values.flatten()
                own[at.to_numpy()] = n.to_numpy()
                rows.append(own.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(rows, pa.binary())], ["lang", "counts"])

    some = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    whole = some.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("found"))
    packed = sorted(whole.mapInArrow(pack, "lang string, counts binary").collect(), key=lambda r: r.lang)
    logp = np.empty((buckets + 1, len(packed)), np.float32)
    n_docs = np.array([np.frombuffer(bytes(r.counts), "<i8")[buckets] for r in packed])
    for k, r in enumerate(packed):
        own = np.frombuffer(bytes(r.counts), "<i8")[:buckets]
        logp[:buckets, k] = np.log(own + SMOOTHING) - np.log(own.sum() + SMOOTHING * buckets)
    logp[buckets] = np.log(n_docs + SMOOTHING) - np.log(n_docs.sum() + SMOOTHING * len(packed))
    return [r.lang for r in packed], logp


def _log_likelihoods(texts: list[str], model: np.ndarray, orders: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log-probabilities of each text's n-grams (texts by languages), and how many n-grams each has.

    A batch's n-grams form the sparse matrix of texts by buckets; its product with the model is taken slab by slab.
    """
    buckets, n_langs = len(model) - 1, model.shape[1]
    total, n = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64)
    slab = max(1, _CELLS // n_langs)
    waiting: list[np.ndarray] = []
    owner: list[int] = []

    def score() -> None:
        if waiting:
            ends = np.cumsum([0, *map(len, waiting[:-1])])
            np.add.at(total, owner, np.add.reduceat(model.take(np.concatenate(waiting), 0), ends, axis=0, dtype=np.float64))
            waiting.clear()
            owner.clear()

    held = 0
    for k, text in enumerate(texts):
        for g in grams(text, orders, buckets):
            n[k] += len(g)
            for at in range(0, len(g), slab):
                part = g[at : at + slab]
                if held + len(part) > slab:
                    score()
                    held = 0
                waiting.append(part)
                owner.append(k)
                held += len(part)
    score()
    return total, n


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, orders: tuple = ORDERS) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``; only its text decides."""
    model = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = model.value
        for batch in batches:
            texts = [x.as_py() or "" for x in batch["text"]]
            said, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            told = [k for k, text in enumerate(texts) if langs and _has_letter(text)]
            if told:
                total, n = _log_likelihoods([texts[k] for k in told], matrix, orders)
                total += matrix[-1]
                # Overlapping n-grams are far from independent: a text's evidence counts as of about its square root.
                p = np.exp((total - total.max(1, keepdims=True)) / np.maximum(1.0, np.sqrt(n))[:, None])
                said[told] = np.array(langs, object)[total.argmax(1)]
                score[told] = p.max(1) / p.sum(1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(said, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    Learns from rows with text and lang that aren't held out (CRC-32 of the doc_id's digits, modulo 4, is 2).  ``score``
    is the share of the likeliest language.  Null texts, those without a letter, and all if there is nothing to learn
    from, are ``und`` with score 0.  Null ids are never held out.  Rows repeat as in ``docs``; no other column is used.
    """
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, logp = train(seen.where(~held_out(F.col("doc_id"))), sample_docs)
    return predict(seen, langs, logp).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
