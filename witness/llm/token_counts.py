"""Token counts: an exact histogram of encoded lengths whose suffix sums answer for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from witness.llm.common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's public tokenizer splits texts before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in pieces cut where the pattern starts a new piece anyway.
PIECE = 200_000
#: Lengths that one block of the suffix sums spans.
BLOCK = 512

_encoders: dict = {}


def _encoder(raw: bytes, pattern: str):
    """The encoder of this Python process, built once."""
    key = (len(raw), pattern)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts before a blank that stands between a letter and a letter: no token of the pattern spans such a place."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(" ", at + 1, at + size)
        while end > at and not (text[end - 1].isalpha() and text[end + 1].isalpha()):
            end = text.rfind(" ", at + 1, end)
        if end <= at:  # no such place in this stretch: look ahead for the next
            end = text.find(" ", at + size)
            while end > 0 and not (text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
                end = text.find(" ", end + 1)
            if end < 0:
                break
        yield text[at:end]
        at = end
    yield text[at:]


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens for each row of ``docs``; null texts have 0 tokens. Special tokens' strings are ordinary text."""
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(raw.value, pattern).encode_ordinary
        for batch in batches:
            n = [sum(len(encode(p)) for p in pieces(t.as_py() or "")) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L of a histogram: n_tokens (= L), n_docs, docs_at_least, tokens_at_least, truncated_total,
    share_at_most.

    ``truncated_total`` is how many tokens are left if every text is cut at L; ``share_at_most`` the share of texts of
    L tokens or fewer, which makes quantiles a lookup.  Suffix sums run within blocks of lengths and over the blocks'
    totals, so that no task sorts all lengths.
    """
    rows = hist.withColumn("_b", F.floor(F.col("n_tokens") / block)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = rows.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_s")).select(
        "_b", zero(F.sum("_d").over(later)).alias("_d"), zero(F.sum("_s").over(later)).alias("_s"),
        F.sum("_d").over(all_rows).alias("_all"), F.sum("_s").over(all_rows).alias("_sum"),
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("n_tokens"))
    docs, tokens = F.sum("n_docs").over(inside) + F.col("_d"), F.sum("_t").over(inside) + F.col("_s")
    return (
        rows.join(totals, "_b")
        .withColumns({"docs_at_least": docs, "tokens_at_least": tokens})
        .select(
            "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
            (F.col("_sum") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
            ((F.col("_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_all")).alias("share_at_most"),
        )
    )


def truncated_totals(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """limit, docs_over, truncated_total for any context limits (column ``limit``), from ``suffix_sums``.

    The next length that occurs at or above a limit answers for it: what is cut at that length, less what the texts
    of at least that length lose on the way down.
    """
    above = limits.join(sums, F.col("n_tokens") >= F.col("limit"), "left").groupBy("limit").agg(
        F.min_by(F.struct("n_tokens", "docs_at_least", "truncated_total"), "n_tokens").alias("s"))
    whole = sums.agg(F.max("truncated_total").alias("_whole"))
    lost = (F.col("s.n_tokens") - F.col("limit")) * F.col("s.docs_at_least")
    return above.join(F.broadcast(whole)).select(
        "limit",
        F.coalesce("s.docs_at_least", F.lit(0)).alias("docs_at_least"),
        F.coalesce(F.col("s.truncated_total") - lost, "_whole", F.lit(0)).alias("truncated_total"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least that share of the texts don't exceed."""
    wanted = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("share_at_most") >= s, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return sums.agg(F.array(*wanted).alias("a")).select(F.inline("a"))


def length_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``suffix_sums`` of the encoded lengths of all rows of ``docs``; an empty table gives an empty one.

    Null and empty texts count with length 0.  Repeated rows count as often as they are there.  Other columns are not
    looked at.
    """
    return suffix_sums(cut(histogram(encoded_lengths(docs, vocabulary))))
