"""The drop folder: JSON files in, verdicts and files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def items_of_files(files: DataFrame) -> DataFrame:
    """path, pos, payload: a file's array, its ``items``, or the one object it is; pos -1 and no payload if unreadable."""
    raw = F.trim("value")
    many = F.from_json(raw, "array<string>")
    inner = F.from_json(F.get_json_object(raw, "$.items"), "array<string>")
    one = F.when(F.from_json(raw, "map<string,string>").isNotNull() & raw.startswith("{"), F.array(raw))
    found = F.when(raw.startswith("["), many).otherwise(F.coalesce(inner, one))
    return files.select("path", F.posexplode_outer(found).alias("pos", "payload")).withColumn("pos", F.coalesce("pos", F.lit(-1)))


def read_drop_folder(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("text").option("wholetext", True).load(path).select("value", F.col("_metadata.file_path").alias("path"))
    return items_of_files(files)


def stream_drop_folder(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """The same as a stream; files that are done are moved to ``archive`` when it is given."""
    reader = spark.readStream.format("text").option("wholetext", True).schema("value string")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return items_of_files(reader.load(path).select("value", F.col("_metadata.file_path").alias("path")))


def route_files(verdicts: DataFrame) -> DataFrame:
    """path, folder: ``failed`` only when nothing of the file landed and something failed, or it couldn't be read."""
    return verdicts.groupBy("path").agg(
        F.when((F.count_if(F.col("verdict") != "failed") == 0) | F.bool_or(F.col("pos") < 0), "failed").otherwise("processed").alias("folder")
    )


def write_items(items: DataFrame, path: str) -> DataFrame:
    """Writes NDJSON partitions and returns counts by source and class, as an envelope would carry them."""
    items.write.mode("errorifexists").json(path)
    return envelope_counts(items)


def envelope_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("source", "source_class").agg(F.count(F.lit(1)).alias("n"))
