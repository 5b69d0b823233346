"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from witness.operators.graph import components
from witness.plans.lineage import cut, drop_cut, shared_dir

__all__ = ["SPACE", "WORD", "components", "cut", "drop_cut", "parts", "row_key", "shared_dir"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns that tell rows apart by id and text; rows alike in both are interchangeable. Nulls get a value."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_th"),
    ]
