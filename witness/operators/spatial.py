"""Spatial tables: features, polygons and distances, joined by cells and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witness.functions.geo import around, cells, haversine_m, in_frame
from witness.operators.cover import inside_cells

#: Polygon edges that may be broadcast; more are resolved by cells.
MAX_EDGES = 200_000
BAND_DEGREES = 0.05


def inside(points: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """id, area (and layer): areas that hold each point (id, lng, lat), by the even-odd rule over all rings.

    ``edges`` has one row per side: area, x1, y1, x2, y2; the sides of an area form closed rings.  A side counts where it
    crosses the point's latitude to the right of it, so holes take care of themselves.  Points that share a place are
    tested once; points without one are in no area.  Up to ``max_edges`` sides are broadcast and meet points by latitude
    bands; more are resolved by cells (``cover``).  Areas that go on beyond 180 degrees also hold points that are written
    a turn away.
    """
    names = [c for c in ("layer", "area") if c in edges.columns]
    all_of = edges.agg(F.count(F.lit(1)).alias("n"), F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east")).first()
    turns = [0.0] + [t for t, over in ((360.0, (all_of.east or 0) > 180), (-360.0, (all_of.west or 0) < -180)) if over]
    placed = points.where("lng IS NOT NULL AND lat IS NOT NULL").select("id", "lng", "lat")
    if len(turns) > 1:
        placed = placed.select("id", F.explode(F.array(*(F.col("lng") + t for t in turns))).alias("lng"), "lat")
    spots = placed.select("lng", "lat").distinct()
    hit = _inside_bands(spots, edges, names) if all_of.n <= max_edges else inside_cells(spots, edges, names)
    found = placed.join(hit, ["lng", "lat"]).select("id", *names)
    return found.distinct() if len(turns) > 1 else found


def _inside_bands(spots: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    band = lambda y: F.floor(y / BAND_DEGREES)
    sides = edges.where("y1 <> y2").select("*", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("_band"))
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (
        F.col("lng") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    )
    met = spots.withColumn("_band", band(F.col("lat"))).join(F.broadcast(sides), "_band").where(crosses)
    return met.groupBy("lng", "lat", *names).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")


def reports_near(places: DataFrame, items: DataFrame, metres: float) -> DataFrame:
    """place, n, top, mean: items within ``metres`` of each place, joined by cell."""
    p = around(places.select("place", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")), metres, "_c", "p_lat", "p_lng")
    i = items.where("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng", "value", cells(F.col("lat"), F.col("lng"), metres).alias("_c"))
    near = i.join(p, "_c").where(haversine_m(F.col("p_lat"), F.col("p_lng"), F.col("lat"), F.col("lng")) <= metres)
    return near.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.avg("value").alias("mean"))


def looks_projected(x: Column, y: Column) -> Column:
    """A coordinate that can't be in degrees."""
    return (F.abs(x) > 180) | (F.abs(y) > 90)


def require_degrees(rows: DataFrame, x: str = "lng", y: str = "lat") -> DataFrame:
    """The rows, or an error when one of them isn't in degrees."""
    bad = looks_projected(F.col(x), F.col(y))
    told = F.raise_error(F.lit("coordinates are not longitude and latitude")).cast("double")
    return rows.withColumn(x, F.when(bad, told).otherwise(F.col(x)))


def features(rows: DataFrame, where: str | None = None, frame: tuple | None = None, at: tuple | None = None, near: tuple | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Rows by attributes and at most one of: a frame, areas that hold the point ``at`` (lng, lat), or (lng, lat, metres)."""
    if sum(x is not None for x in (frame, at, near)) > 1:
        raise ValueError("one spatial filter at most")
    found = rows.where(where) if where else rows
    if frame is not None:
        found = found.where(in_frame(F.col("lat"), F.col("lng"), frame))
    if near is not None:
        lng, lat, metres = near
        found = found.where(haversine_m(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng)) <= metres)
    if at is not None:
        spot = rows.sparkSession.createDataFrame([(0, *at)], "id int, lng double, lat double")
        found = found.join(inside(spot, edges).select("area").distinct(), "area", "left_semi")
    return found


def select_features(rows: DataFrame, columns: list[str], order: list[str], distinct: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    found = rows.select(*columns)
    found = (found.distinct() if distinct else found).orderBy(*order).offset(offset)
    return found.limit(limit) if limit is not None else found


def extent(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north")
    )


def capped(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows, each told whether there are more."""
    some = rows.orderBy(*order).limit(limit + 1)
    n = some.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return some.orderBy(*order).limit(limit).join(F.broadcast(n))


def layers_at(points: DataFrame, edges: DataFrame) -> DataFrame:
    """id, layer, first area, hits and how many more: every layer that a point lies in."""
    hit = inside(points, edges)
    return hit.groupBy("id", "layer").agg(F.min("area").alias("area"), F.count(F.lit(1)).alias("hits"), (F.count(F.lit(1)) - 1).alias("more"))


def points_of(coordinates: Column) -> Column:
    """(x, y) pairs of a nested coordinate text such as [[[1,2],[3,4]]]: every innermost pair."""
    pairs = F.regexp_extract_all(coordinates, F.lit(r"\[\s*(-?[\d.eE+]+\s*,\s*-?[\d.eE+]+)(?:\s*,[^\]\[]*)?\]"), F.lit(1))
    return F.transform(pairs, lambda p: F.transform(F.split(p, r"\s*,\s*"), lambda x: x.try_cast("double")))


def vertex_mean(coordinates: Column) -> Column:
    """Mean of all vertices; a ring's closing vertex counts again."""
    pts = points_of(coordinates)
    mean = lambda k: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[k]) / F.size(pts)
    return F.when(F.size(pts) > 0, F.struct(mean(0).alias("lng"), mean(1).alias("lat")))


def first_vertex(coordinates: Column) -> Column:
    pts = points_of(coordinates)
    return F.when(F.size(pts) > 0, F.struct(pts[0][0].alias("lng"), pts[0][1].alias("lat")))


def flat_rows(features_json: DataFrame, column: str = "feature") -> DataFrame:
    """Attributes as a map, with the first vertex as lat and lng unless they are there already."""
    geometry = F.get_json_object(column, "$.geometry.coordinates")
    # A bare point is a pair itself.
    spot = first_vertex(F.concat(F.lit("["), geometry, F.lit("]")))
    props = F.from_json(F.coalesce(F.get_json_object(column, "$.properties"), F.get_json_object(column, "$.attributes")), "map<string,string>")
    return features_json.select("*", props.alias("properties")).withColumns({
        "lat": F.coalesce(F.try_element_at("properties", F.lit("lat")).try_cast("double"), spot["lat"]),
        "lng": F.coalesce(F.try_element_at("properties", F.lit("lng")).try_cast("double"), spot["lng"]),
    })
