"""Distances, frames and cells as column expressions."""

from __future__ import annotations

from math import pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres; null if a coordinate is."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    # Not ``least``, which passes over nulls.
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


_H_SQL = (
    "pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)"
)
HAVERSINE_SQL = f"2 * 6371000.0::DOUBLE * asin(sqrt(CASE WHEN {_H_SQL} > 1 THEN 1 ELSE {_H_SQL} END))"


def in_frame(lat: Column, lng: Column, frame: tuple[float, float, float, float]) -> Column:
    """Inside (west, south, east, north), edges included."""
    west, south, east, north = frame
    return lng.between(west, east) & lat.between(south, north)


def _columns(band: Column, step: float) -> Column:
    """Into how many columns the globe is cut in a band of latitude: as many as are at least ``step`` high and wide."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band), F.abs(band + 1)) * step)
    return F.greatest(F.lit(1).cast("long"), F.floor(360.0 * F.cos(F.radians(far)) / step))


def cells(lat: Column, lng: Column, radius_m: float) -> Column:
    """The point's cell, for points to meet within ``radius_m``: see ``around``.

    Cells are bands of latitude, each cut into columns by its own width, so that neighbours are few at any latitude.
    Columns go round the globe: cells meet at 180 degrees.
    """
    # A degree of latitude has some 200 m more than this; that outweighs rounding.
    step = radius_m / 111_000.0
    band = F.floor(lat / step)
    n = _columns(band, step)
    return F.struct(band.alias("y"), F.pmod(F.floor((lng + 180.0) / 360.0 * n), n).alias("x"))


def around(rows: DataFrame, radius_m: float, name: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """The rows with a place, each once for every cell that may hold points within the radius of it.

    These lie in three bands; near a pole a circle covers all of a band.
    """
    step, angle, y = radius_m / 111_000.0, radius_m / EARTH_M, F.radians(lat)
    bands = rows.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).withColumn("_y", F.explode(F.array(*(F.floor(F.col(lat) / step) + k for k in (-1, 0, 1)))))
    over_pole = F.abs(y) + angle >= pi / 2 - 1e-6
    reach = F.when(over_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(sin(angle)) / F.cos(y))))) * (1 + 1e-9) + 1e-9
    wide = bands.withColumns({"_n": _columns(F.col("_y"), step), "_reach": reach})
    end = lambda r: F.floor((F.col(lng) + r + 180.0) / 360.0 * F.col("_n"))
    ends = wide.withColumns({"_lo": end(-F.col("_reach")), "_hi": end(F.col("_reach"))})
    whole = F.col("_hi") - F.col("_lo") + 1 >= F.col("_n")
    columns = F.sequence(F.when(whole, F.lit(0).cast("long")).otherwise(F.col("_lo")), F.when(whole, F.col("_n") - 1).otherwise(F.col("_hi")))
    met = ends.withColumn("_x", F.explode(columns))
    return met.withColumn(name, F.struct(F.col("_y").alias("y"), F.pmod("_x", "_n").alias("x"))).drop("_y", "_n", "_reach", "_lo", "_hi", "_x")


def words_of_distance(metres: Column) -> Column:
    return F.when(metres < 1000, F.format_string("%.0fm", metres)).otherwise(F.format_string("%.1fkm", metres / 1000))


def words_of_hours(hours: Column) -> Column:
    """0m, 45m, 3.5h, 2d: how old something is."""
    return (
        F.when(hours <= 0, "0m").when(hours < 1, F.format_string("%.0fm", hours * 60))
        .when(hours < 48, F.format_string("%.1fh", hours)).otherwise(F.format_string("%.0fd", hours / 24))
    )
