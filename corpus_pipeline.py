"""From raw documents to a training mix: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witness.llm import decontaminate, mixing, quality_ranker, similar, simhash, suffix_dedup
from witness.llm.common import shared_dir
from witness.plans.lineage import drop_path, scratch

#: A shorter bound than the operator's own: passages of some fifty words count as repeats.
MIN_PASSAGE_BYTES = 256


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_ranker.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more stays, the one with the smallest doc_id.

    Candidates come from SimHash fingerprints within four bits, checked exactly; texts as similar with fingerprints farther
    apart are found by their rarest shingles.
    """
    return simhash.first_of_groups(docs, similar.near_duplicates(docs))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand elsewhere are cut out of the texts; every document stays."""
    return suffix_dedup.rewrite(docs, MIN_PASSAGE_BYTES)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with their size, their source's size and target, and the words taken.

    These four columns replace columns of ``docs`` that are named like them.
    """
    new = ("size", "source_size", "target", "taken")
    found = mixing.mix(docs, carry=True).where("taken > 0")
    return found.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in new), *new)


STAGES = [
    ("quality classifier", classify),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
]
#: SQL cannot express the classifier, the fingerprints or the suffix array; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read back.

    A stage's own tables go when its result stands, and a result goes when the next one stands.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
