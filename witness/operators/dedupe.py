"""Deduplication, merging and upserts by ranked windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity(text: Column | None = None) -> Column:
    """What makes two deliveries one observation: the collector's id if there is one, else the words and the time."""
    words = F.md5(text) if text is not None else F.lit("")
    return F.when(
        F.col("external_id").isNotNull(), F.struct(F.col("dataset_id"), F.col("source"), F.lit("id").alias("by"), F.col("external_id").alias("what"))
    ).otherwise(F.struct(F.col("dataset_id"), F.col("source"), F.lit("words").alias("by"), F.concat_ws("|", words, F.col("occurred_at").cast("string")).alias("what")))


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key by ``order``, which must end in an id."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def by_external_id(items: DataFrame) -> DataFrame:
    """First stored version of each (dataset, source, external id); items without one pass."""
    own = first_of(items.where("external_id is not null"), ["dataset_id", "source", "external_id"], ["captured_at", "item_id"])
    return own.unionByName(items.where("external_id is null"))


def by_words(rows: DataFrame, source: str, text: str, at: str, order: list) -> DataFrame:
    """First row of each (source, words, time)."""
    return first_of(rows.withColumn("_m", F.md5(F.coalesce(F.col(text), F.lit("")))), [source, "_m", at], order).drop("_m")


def new_items(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key isn't stored yet; null keys never match."""
    return batch.join(stored.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows, of each key the one with the highest version."""
    return first_of(old.unionByName(new), keys, [F.desc(version)])


def batch_verdicts(items: DataFrame) -> DataFrame:
    """Adds ok and verdict (created, deduped or failed); one bad item never sinks the rest."""
    rank = F.row_number().over(Window.partitionBy("ok", "dataset_id", "source", "external_id").orderBy("item_id"))
    told = F.when(~F.col("ok"), "failed").when(F.col("external_id").isNotNull() & (rank > 1), "deduped").otherwise("created")
    return items.withColumn("verdict", told)


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return verdicts.agg(F.count(F.lit(1)).alias("total"), count("created"), count("deduped"), count("failed"))


def collect_sources(frames: list[tuple[str, DataFrame]], cutoff: str, exempt: str = "official") -> DataFrame:
    """Items of several collectors: the first collector that has an id wins; old ones go unless official."""
    merged = None
    for k, (name, df) in enumerate(frames):
        part = df.withColumn("collector", F.lit(name)).withColumn("_order", F.lit(k))
        merged = part if merged is None else merged.unionByName(part)
    kept = first_of(merged, ["item_id"], ["_order"]).drop("_order")
    return kept.where((F.col("source_class") == exempt) | (F.col("occurred_at") >= F.lit(cutoff).cast("timestamp")))


def collect_report(frames: list[tuple[str, DataFrame]], kept: DataFrame) -> DataFrame:
    """collector, n: what each collector put in; 0 for those without."""
    spark = kept.sparkSession
    names = spark.createDataFrame([(n,) for n, _ in frames], "collector string")
    return names.join(kept.groupBy("collector").agg(F.count(F.lit(1)).alias("n")), "collector", "left").na.fill(0, ["n"])


def flat_feed(posts: DataFrame) -> DataFrame:
    """Posts once each: by url, else by title and the text's first 60 characters."""
    key = F.coalesce(F.col("url"), F.concat_ws("|", F.lit("t"), F.col("title"), F.left(F.coalesce("text", F.lit("")), F.lit(60))))
    return first_of(posts.withColumn("_u", key), ["_u"], ["post_id"]).drop("_u")
