"""Folding members into bubbles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_HOURS = 6.0
TRUTHY = ("true", "yes", "1", "confirmed", "verified")


def fold_bubbles(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mass, clocks, sources and centre of each bubble in one aggregation."""
    return members.groupBy(*(by or ["bubble_id"])).agg(
        F.count(F.lit(1)).alias("mass"),
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
        F.countDistinct("source").alias("source_diversity"),
        F.array_sort(F.collect_set("source_class")).alias("source_classes"),
        F.avg("lat").alias("lat"),
        F.avg("lng").alias("lng"),
    )


def velocity(members: DataFrame) -> DataFrame:
    """Members within an hour of their bubble's newest, the bubble's own clock."""
    newest = F.max("occurred_at").over(Window.partitionBy("bubble_id"))
    return (
        members.withColumn("_n", newest).groupBy("bubble_id")
        .agg(F.count_if(F.col("occurred_at") >= F.col("_n") - F.expr("INTERVAL 1 HOUR")).alias("velocity"))
    )


def score(mass: Column, last_seen: Column, now: str) -> Column:
    """Sort key of boards, never published: mass halved every six hours since the last report."""
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(last_seen)) / 3.6e9
    return mass * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours) / HALF_LIFE_HOURS)


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*TRUTHY)


def number_of(value: Column) -> Column:
    """Numeric text as a number; blank text counts as 0, other text as none."""
    return F.when(F.trim(value) == "", 0.0).otherwise(value.try_cast("double"))


def verification(annotations: DataFrame, members: DataFrame) -> DataFrame:
    """bubble_id, verified_by (different nodes that someone verified), confidence (mean of numeric ones)."""
    notes = annotations.join(members.select(F.col("item_id").alias("node_id"), "bubble_id"), "node_id")
    return notes.groupBy("bubble_id").agg(
        F.countDistinct(F.when((F.col("key") == "verified") & truthy(F.col("value")), F.col("node_id"))).alias("verified_by"),
        F.avg(F.when(F.col("key") == "confidence", number_of(F.col("value")))).alias("confidence"),
    )


def refold_as_at(members: DataFrame, as_at: str) -> DataFrame:
    """Bubbles as far as known at ``as_at``: those without a member then are absent, verification is withheld."""
    known = members.where(F.col("captured_at") <= F.lit(as_at).cast("timestamp"))
    return fold_bubbles(known).join(velocity(known), "bubble_id").withColumn("verified_by", F.lit(None).cast("long"))


def galaxy_centre(members: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Mean place of each bubble's projected members; null if none is."""
    placed = members.select("item_id", "bubble_id").join(coordinates, "item_id", "left")
    return placed.groupBy("bubble_id").agg(*(F.avg(c).alias(c) for c in "xyz"))


def mass_mismatch(bubbles: DataFrame, edges: DataFrame) -> DataFrame:
    """Bubbles whose stored mass isn't their number of member edges."""
    counted = edges.where("rel = 'member_of'").groupBy(F.col("to_id").alias("bubble_id")).agg(F.count(F.lit(1)).alias("counted"))
    both = bubbles.select("bubble_id", "mass").join(counted, "bubble_id", "left").na.fill(0, ["counted"])
    return both.where("mass <> counted")


def impure(members: DataFrame, label: str = "hazard") -> DataFrame:
    """Bubbles whose members carry more than one held-out label."""
    return members.groupBy("bubble_id").agg(F.countDistinct(label).alias("labels")).where("labels > 1")


def originators(records: DataFrame, cluster: str, key: str, band: str) -> DataFrame:
    """Records, different originators and bands of each labelled cluster."""
    return records.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct(key).alias("originators"), F.array_sort(F.collect_set(band)).alias("bands")
    )


def most_common(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value: the most frequent non-blank value, of equals the first in code-point order."""
    v = F.trim(F.col(value))
    counted = rows.select(by, v.alias(value)).where(F.col(value) != "").groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(by).orderBy(F.desc("_n"), value)
    return counted.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(by, value)


def labels(members: DataFrame) -> DataFrame:
    """bubble_id, label: commonest hazard and place (else source)."""
    all_of = members.select("bubble_id").distinct()
    for c in ("hazard", "place", "source"):
        all_of = all_of.join(most_common(members, "bubble_id", c), "bubble_id", "left")
    where = F.coalesce("place", "source", F.lit("location unknown"))
    return all_of.select("bubble_id", F.concat_ws(" — ", F.coalesce("hazard", F.lit("unclassified")), where).alias("label"))


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
