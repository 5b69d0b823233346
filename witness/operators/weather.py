"""Catalogue, gauges, rain days and warnings as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATALOGUE_TEXT = ("id", "title", "layer", "theme", "description", "provider")


def search_catalogue(layers: DataFrame, text: str | None = None, scope: str | None = None, theme: str | None = None, queryable: bool | None = None, raster: bool | None = None) -> DataFrame:
    """Layers by words in any of six fields, and by exact attributes."""
    found = layers
    if text:
        blob = F.lower(F.concat_ws(" ", *CATALOGUE_TEXT))
        for word in text.lower().split():
            found = found.where(blob.contains(word))
    for column, want in (("scope", scope), ("theme", theme), ("queryable", queryable), ("raster", raster)):
        if want is not None:
            found = found.where(F.col(column) == want)
    return found


def gauge_readings(xml: DataFrame, item: str, column: str = "xml") -> DataFrame:
    """at, value, text, units of the named item's readings; text values are kept and no divisor is applied."""
    schema = "Measurement struct<_SiteName:string,DataSource:struct<ItemInfo:array<struct<_ItemNumber:string,ItemName:string,Units:string>>>,Data:struct<E:array<struct<T:string,I1:string,I2:string,I3:string>>>>"
    rows = xml.select(F.from_xml(column, schema).alias("x")).select("x.Measurement.*")
    info = F.filter("DataSource.ItemInfo", lambda i: F.lower(i["ItemName"]) == item.lower())[0]
    e = rows.select(F.col("_SiteName").alias("site"), info["_ItemNumber"].alias("k"), info["Units"].alias("units"), F.explode("Data.E").alias("e"))
    value = F.when(F.col("k") == "1", F.col("e.I1")).when(F.col("k") == "2", F.col("e.I2")).when(F.col("k") == "3", F.col("e.I3"))
    return e.where("k IS NOT NULL").select("site", F.try_to_timestamp("e.T").alias("at"), value.try_cast("double").alias("value"), value.alias("text"), "units")


def stale_gauges(readings: DataFrame, now: str, hours: float) -> DataFrame:
    """site, latest, stale: the newest reading of each gauge, and whether it is too old to be live."""
    old = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours * 3600)))
    return readings.groupBy("site").agg(F.max("at").alias("latest")).withColumn("stale", F.col("latest") < old)


def extreme_rain_days(rain: DataFrame, peaks: DataFrame, gauges: list[str], least: float = 25.0) -> DataFrame:
    """day, one column per gauge, river_peak, corroborated_by_river: days on which any gauge reached ``least``."""
    daily = rain.groupBy("day").pivot("gauge", gauges).agg(F.sum("mm"))
    wet = daily.where(F.greatest(*(F.coalesce(F.col(g), F.lit(0.0)) for g in gauges)) >= least)
    return wet.join(peaks, "day", "left").withColumn("corroborated_by_river", F.col("river_peak").isNotNull())


def unique_warnings(warnings: DataFrame) -> DataFrame:
    """Warnings once per (identifier, area, onset): the earliest snapshot."""
    key = [F.coalesce(F.col(c), F.lit("")) for c in ("identifier", "area", "onset")]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("snapshot", "warning_id"))
    return warnings.withColumn("_k", rank).where("_k = 1").drop("_k")


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("event", "severity").agg(F.count(F.lit(1)).alias("n"))


def likely_warning_days(mentions: DataFrame, least: int = 3) -> DataFrame:
    """Days with at least ``least`` different mentions (by link)."""
    once = mentions.where("url IS NOT NULL").groupBy("url").agg(F.min("day").alias("day"))
    return once.groupBy("day").agg(F.count(F.lit(1)).alias("mentions")).where(F.col("mentions") >= least)


def is_wellington(area: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(area), w))
