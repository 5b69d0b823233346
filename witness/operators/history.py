"""Bubbles as at any time from snapshots: an as-at read takes one snapshot and the days since it, not all members.

A snapshot is a table of weighted members, the same shape as members themselves have with weight one, so folding a
snapshot with the members after it is folding rows.  It has a row for each bubble, source, source class and, within an
hour of the bubble's newest report, time of report: older ones can't count for a velocity again, as the newest only moves on.

    members/day=<captured>/*.parquet      snapshots/upto=<day>/*.parquet
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from witness.plans.lineage import drop_path

COLUMNS = ("bubble_id", "source", "source_class", "occurred_at", "captured_at", "lat", "lng")
KEY = ("bubble_id", "source", "source_class", "at")


def weighted(members: DataFrame) -> DataFrame:
    """Each member as a row of weight one."""
    here = lambda c: F.col(c).isNotNull().cast("long").alias(f"n_{c}")
    return members.select(
        "bubble_id", "source", "source_class", F.col("occurred_at").alias("at"), F.lit(1).cast("long").alias("n"), F.col("occurred_at").alias("first"), F.col("occurred_at").alias("last"),
        F.col("lat").cast("double").alias("lat"), here("lat"), F.col("lng").cast("double").alias("lng"), here("lng"),
    )


def compress(rows: DataFrame) -> DataFrame:
    """Rows of equal key as one; times of report that no later velocity counts are let go."""
    newest = F.max("last").over(Window.partitionBy("bubble_id"))
    add = lambda c: F.sum(c).alias(c)
    # Added up before the window, so that a bubble's rows are as few as its different times.
    once = rows.groupBy(*KEY).agg(add("n"), F.min("first").alias("first"), F.max("last").alias("last"), *(add(c) for c in ("lat", "n_lat", "lng", "n_lng")))
    kept = once.withColumn("_newest", newest).withColumn("at", F.when(F.col("at") >= F.col("_newest") - F.expr("INTERVAL 1 HOUR"), F.col("at")))
    return kept.groupBy(*KEY).agg(add("n"), F.min("first").alias("first"), F.max("last").alias("last"), *(add(c) for c in ("lat", "n_lat", "lng", "n_lng")))


def fold(rows: DataFrame) -> DataFrame:
    """What ``fold.refold_as_at`` gives, from weighted members."""
    newest = rows.groupBy("bubble_id").agg(F.max("last").alias("_newest"))
    recent = rows.where("at IS NOT NULL").groupBy("bubble_id", "at").agg(F.sum("n").alias("n")).join(newest, "bubble_id")
    speed = recent.groupBy("bubble_id").agg(F.sum(F.when(F.col("at") >= F.col("_newest") - F.expr("INTERVAL 1 HOUR"), F.col("n")).otherwise(0)).alias("velocity"))
    mean = lambda c: F.try_divide(F.sum(c), F.sum(f"n_{c}")).alias(c)
    folded = rows.groupBy("bubble_id").agg(
        F.sum("n").alias("mass"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.countDistinct("source").alias("source_diversity"),
        F.array_sort(F.collect_set("source_class")).alias("source_classes"), mean("lat"), mean("lng"),
    )
    return folded.join(speed, "bubble_id", "left").na.fill(0, ["velocity"]).withColumn("verified_by", F.lit(None).cast("long"))


def _days(spark: SparkSession, path: str, name: str) -> list[date]:
    """Days in the folder names below ``path``, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
    return sorted(date.fromisoformat(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}=") and n[len(name) + 1 :][:1].isdigit())


def snapshots(spark: SparkSession, path: str) -> list[date]:
    return _days(spark, f"{path}/snapshots", "upto")


def add(members: DataFrame, path: str) -> None:
    """Appends members by the day on which they were captured.

    Snapshots that should have held some of them are deleted; ``advance`` makes them anew.  Members without a time of
    capture are not known at any time and are left out.  The same holds after an item has moved to another bubble: ``forget`` its day.
    """
    rows = members.where("captured_at IS NOT NULL").select(*COLUMNS, F.to_date("captured_at").alias("day"))
    first = rows.agg(F.min("day")).first()[0]
    if first is None:
        return
    forget(members.sparkSession, path, first)
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(f"{path}/members")


def forget(spark: SparkSession, path: str, since: date) -> None:
    """Deletes the snapshots that hold members of the day or of later ones."""
    for day in snapshots(spark, path):
        if day > since:
            drop_path(spark, f"{path}/snapshots/upto={day}")


def _known(spark: SparkSession, path: str, day: date) -> tuple[DataFrame | None, DataFrame]:
    """The last snapshot up to ``day`` and the members since it, captured on ``day`` at the latest."""
    before = [d for d in snapshots(spark, path) if d <= day]
    rest = spark.read.parquet(f"{path}/members").where(F.col("day") <= F.lit(day))
    if not before:
        return None, rest
    return spark.read.parquet(f"{path}/snapshots/upto={before[-1]}"), rest.where(F.col("day") >= F.lit(before[-1]))


def _together(old: DataFrame | None, rest: DataFrame) -> DataFrame:
    return weighted(rest) if old is None else old.unionByName(weighted(rest))


def advance(spark: SparkSession, path: str, upto: date) -> None:
    """Writes the snapshot of all members captured before the day ``upto``, from the one before it and the days between."""
    old, rest = _known(spark, path, upto)
    if upto not in snapshots(spark, path):
        compress(_together(old, rest.where(F.col("day") < F.lit(upto)))).write.mode("overwrite").parquet(f"{path}/snapshots/upto={upto}")


def refold_as_at(spark: SparkSession, path: str, as_at: datetime) -> DataFrame:
    """Bubbles as far as known at ``as_at`` (in the session's time zone), as ``fold.refold_as_at`` gives them from all members."""
    old, rest = _known(spark, path, as_at.date())
    return fold(_together(old, rest.where(F.col("captured_at") <= F.lit(as_at.isoformat(" ")).cast("timestamp"))))
