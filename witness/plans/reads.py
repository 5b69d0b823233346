"""Published reads over clusters.  ``score`` orders and is never published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from witness import model
from witness.functions.geo import haversine_m, in_frame
from witness.operators import fold, store
from witness.operators.spatial import inside

#: Members to their origins (bubble_id, item_id, origin_id), such as ``origins.author_origins`` or ``origins.linked_origins``.
#: Reads call it on the members that they may know, never on all: a later item can join sets that were apart.
OriginsOf = Callable[[DataFrame], DataFrame]


def located(members: DataFrame) -> DataFrame:
    """bubble_id, lat, lng, radius_m: the mean of placed members and how far the farthest is; no radius for one."""
    both = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    mean = lambda c: F.avg(F.when(both, F.col(c))).alias(f"c_{c}")
    centre = members.groupBy("bubble_id").agg(mean("lat"), mean("lng"), F.count_if(both).alias("_n"))
    far = members.join(centre, "bubble_id").groupBy("bubble_id").agg(
        F.first("c_lat").alias("lat"), F.first("c_lng").alias("lng"), F.first("_n").alias("_n"), F.max(haversine_m(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))).alias("_far")
    )
    return far.select("bubble_id", "lat", "lng", F.when(F.col("_n") > 1, F.round("_far")).cast("long").alias("radius_m"))


def scored_signals(members: DataFrame, origins: DataFrame, now: str) -> DataFrame:
    """Counts of each cluster from the members in hand."""
    counted = origins.groupBy("bubble_id").agg(F.countDistinct("origin_id").alias("independent_sources"))
    folded = fold.fold_bubbles(members)
    return folded.join(counted, "bubble_id").join(located(members).drop("lat", "lng"), "bubble_id").withColumn("score", F.round(fold.score(F.col("mass"), F.col("last_seen"), now), 9))


def top_bubbles(members: DataFrame, now: str, limit: int = 500) -> DataFrame:
    """bubble_id of the first ``limit`` bubbles by score."""
    bubbles = fold.fold_bubbles(members, ["bubble_id", "dataset_id"]).withColumn("score", F.round(fold.score(F.col("mass"), F.col("last_seen"), now), 9))
    return bubbles.orderBy(F.desc("score"), F.desc("last_seen"), F.desc("bubble_id")).limit(limit).select("bubble_id")


def top_members(members: DataFrame, now: str, limit: int = 500) -> DataFrame:
    """Members of those bubbles: all that a map of them needs, be it origins, facts, grades or history."""
    return members.join(top_bubbles(members, now, limit), "bubble_id", "left_semi")


def map_layer(
    members: DataFrame, origins_of: OriginsOf, grades: DataFrame, now: str, frame: tuple | None = model.CITY_FRAME, min_credibility: int | None = None, limit: int = 500,
    as_at: str | None = None, strict: bool = False, events: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(placed, unplaceable) clusters.

    The top ``limit`` bubbles by score, then members as known at ``as_at`` (bubbles left empty go) and their origins, then the credibility
    floor (ungraded ones fall), then those without a place apart, then the frame.  As at an earlier time a cluster shows
    its grade of then; before its first grade the present one, unless ``strict``.
    """
    known = top_members(members, now, limit)
    known = known.where(F.col("captured_at") <= F.lit(as_at).cast("timestamp")) if as_at else known
    shown = scored_signals(known, origins_of(known), now)
    if as_at and events is not None:
        then = store.last_before(events, as_at).select("bubble_id", F.concat("reliability", F.col("credibility").cast("string")).alias("_then"), F.col("credibility").alias("_c"))
        graded = shown.join(then, "bubble_id", "left").join(grades, "bubble_id", "left")
        now_grade = F.concat("reliability", F.col("credibility").cast("string"))
        graded = graded.withColumns({"grade": F.col("_then") if strict else F.coalesce("_then", now_grade), "_cred": F.col("_c") if strict else F.coalesce("_c", "credibility")})
    else:
        graded = shown.join(grades, "bubble_id", "left").withColumns({"grade": F.concat("reliability", F.col("credibility").cast("string")), "_cred": F.col("credibility")})
    if min_credibility is not None:
        graded = graded.where(F.col("_cred") <= min_credibility)
    columns = ("bubble_id", "mass", "independent_sources", "grade", "lat", "lng", "radius_m")
    placed = graded.where("lat IS NOT NULL")
    placed = placed.where(in_frame(F.col("lat"), F.col("lng"), frame)) if frame else placed
    return placed.select(*columns), graded.where("lat IS NULL").select("bubble_id", "mass", "grade")


def capture_start(members: DataFrame) -> DataFrame:
    return members.agg(F.min("captured_at").alias("captured_at"))


def _joined_by(edges: DataFrame | None, items: DataFrame) -> DataFrame:
    """``items`` with the weight and reason of their membership, null where no edge says."""
    if edges is None:
        return items.withColumns({"weight": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})
    member = edges.where("rel = 'member_of'").select(F.col("from_id").alias("item_id"), "weight", "reason")
    return items.join(member, "item_id", "left")


def provenance(members: DataFrame, origins_of: OriginsOf, bubble: str, as_at: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Rows behind one cluster: item, origin, both clocks, why it is a member; nothing known later than ``as_at``, and
    origins that follow from what was known then."""
    own = members.where(F.col("bubble_id") == bubble)
    own = own.where(F.col("captured_at") <= F.lit(as_at).cast("timestamp")) if as_at else own
    rows = _joined_by(edges, own.drop("origin_id").join(origins_of(own).select("item_id", "origin_id"), "item_id"))
    return rows.select("item_id", "origin_id", "source", "author", "occurred_at", "captured_at", "weight", "reason")


def origin_sets(rows: DataFrame) -> DataFrame:
    """origin_id, items: origins of a cluster's provenance that hold more than one item, with their items."""
    found = rows.groupBy("origin_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return found.where(F.size("items") > 1)


def signal_detail(
    members: DataFrame, origins_of: OriginsOf, events: DataFrame, bubble: str, as_at: str | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """One row: counts, provenance, collapsed origins and grade history oldest first."""
    rows = provenance(members, origins_of, bubble, as_at, edges)
    history = events.where(F.col("bubble_id") == bubble)
    history = history.where(F.col("at") <= F.lit(as_at).cast("timestamp")) if as_at else history
    past = history.agg(F.sort_array(F.collect_list(F.struct("at", "item_id", "to_grade"))).alias("history"))
    sets = origin_sets(rows).agg(F.sort_array(F.collect_list(F.struct("origin_id", "items"))).alias("origins"))
    line = F.struct("occurred_at", "item_id", "origin_id", "source", "weight", "reason")
    head = rows.agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("origin_id").alias("independent_sources"), F.sort_array(F.collect_list(line)).alias("provenance")
    )
    missing = F.raise_error(F.lit("no such cluster, or nothing known of it then")).cast("long")
    told = F.when(F.col("items") == 0, missing).otherwise(F.col("items"))
    return head.join(F.broadcast(past)).join(F.broadcast(sets)).withColumn("items", told)  # one row each


def bubble_detail(members: DataFrame, annotations: DataFrame, bubble: str, edges: DataFrame | None = None) -> DataFrame:
    """Members of one bubble newest first, with all their columns (the payload among them), all of their annotations
    and why they are members."""
    own = _joined_by(edges, members.where(F.col("bubble_id") == bubble))
    about = annotations.join(own.select(F.col("item_id").alias("node_id")), "node_id", "left_semi")
    notes = about.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("annotations"))
    found = own.join(notes, F.col("item_id") == F.col("node_id"), "left").drop("node_id")
    return found.orderBy(F.desc("occurred_at"), F.desc("item_id"))


def alerts_in_place(feed: DataFrame, members: DataFrame, issues: DataFrame) -> DataFrame:
    """A page of the alert feed with what it is about and where: ``issue`` and place from today's members (null where
    none is placed); counts and grade stay those of the event."""
    shown = feed.select("bubble_id").distinct()
    where = located(members.join(shown, "bubble_id", "left_semi")).select("bubble_id", "lat", "lng")
    return feed.join(issues.select("bubble_id", "issue"), "bubble_id", "left").join(where, "bubble_id", "left")


def board(members: DataFrame, now: str, start: str, end: str, limit: int = 500) -> DataFrame:
    """bubble_id, rank, mass: bubbles of a window by internal score."""
    bubbles = fold.fold_bubbles(members, ["bubble_id", "dataset_id"]).withColumn("score", F.round(fold.score(F.col("mass"), F.col("last_seen"), now), 9))
    found = store.bubbles_overlapping(bubbles, start, end, limit)
    rank = Window.orderBy(F.desc("score"), F.desc("last_seen"), F.desc("bubble_id"))  # at most ``limit`` rows
    return found.withColumn("rank", F.row_number().over(rank)).select("bubble_id", "rank", "mass")


def lanes(bubbles: DataFrame, fast: int = 4, big: int = 3) -> DataFrame:
    """lane, bubble_id, rank: the ``fast`` quickest of two items or more, then the ``big`` largest of the rest."""
    real = bubbles.where("mass >= 2")
    speed = Window.orderBy(F.desc("velocity"), F.desc("mass"), "bubble_id")
    quick = real.where("velocity > 0").orderBy(F.desc("velocity"), F.desc("mass"), "bubble_id").limit(fast).withColumn("rank", F.row_number().over(speed)).select(F.lit("picking up speed").alias("lane"), "bubble_id", "rank")
    rest = real.join(quick.select("bubble_id"), "bubble_id", "left_anti")
    size = Window.orderBy(F.desc("mass"), "bubble_id")
    most = rest.orderBy(F.desc("mass"), "bubble_id").limit(big).withColumn("rank", F.row_number().over(size)).select(F.lit("most talked about").alias("lane"), "bubble_id", "rank")
    return quick.unionByName(most)


def trend_bands(bubbles: DataFrame) -> DataFrame:
    """bubble_id, band by the board's own clock, the newest report of any cluster; single items are only counted."""
    clock = bubbles.agg(F.max("last_seen").alias("_clock"))
    fresh = F.unix_micros("_clock") - F.unix_micros("last_seen") <= 3_600_000_000
    band = F.when(F.col("mass") < 2, "single").when(fresh & (F.col("velocity") >= 2), "moving").when(fresh, "building").otherwise("quiet")
    return bubbles.join(F.broadcast(clock)).select("bubble_id", band.alias("band"))


def independence_meter(independent: Column, total: Column) -> Column:
    """Percent once there are more than 24 items."""
    return F.when(total > 24, F.round(100.0 * independent / total)).cast("int")


def amplification(items: Column, origins: Column) -> Column:
    return F.when(items > origins, items - origins)


def impact_zones(clusters: DataFrame, named: DataFrame, edges: DataFrame) -> DataFrame:
    """area, mass, top_bubble, heat: clusters by area, by the name in their label first, else by polygon.

    Areas of a single item are hidden; heat is relative to the busiest.
    """
    by_name = clusters.join(named, "bubble_id").select("bubble_id", "mass", "area")
    others = clusters.join(by_name.select("bubble_id"), "bubble_id", "left_anti")
    spots = inside(others.select(F.col("bubble_id").alias("id"), "lng", "lat"), edges).groupBy("id").agg(F.min("area").alias("area"))
    by_place = others.join(spots, F.col("bubble_id") == F.col("id")).select("bubble_id", "mass", "area")
    zones = by_name.unionByName(by_place).groupBy("area").agg(F.sum("mass").alias("mass"), F.max_by("bubble_id", F.struct("mass", "bubble_id")).alias("top_bubble")).where("mass >= 2")
    busiest = zones.agg(F.max("mass").alias("_most"))
    heat = F.when(F.col("mass") >= F.greatest(F.lit(8.0), F.col("_most") * 0.4), "hot").when(F.col("mass") >= 5, "warm").otherwise("mild")
    return zones.join(F.broadcast(busiest)).select("area", "mass", "top_bubble", heat.alias("heat"))


def display_label(label: Column) -> Column:
    """hazard, place for a heading: the label's parts, the first part of an address, cut at 24 characters."""
    parts = F.split(label, " — ")
    hazard, place = F.replace(F.element_at(parts, 1), F.lit("_"), F.lit(" ")), F.trim(F.element_at(F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), ","), 1))
    upper = lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 10_000))
    cut = F.when(F.length(place) > 24, F.concat(F.left(place, F.lit(23)), F.lit("…"))).otherwise(place)
    return F.struct(upper(hazard).alias("hazard"), upper(cut).alias("place"))


def collapsed(origins: DataFrame) -> DataFrame:
    """Origins that hold more than one item."""
    return origins.groupBy("bubble_id", "origin_id").agg(F.count(F.lit(1)).alias("items")).where("items > 1")


def echoes(origins: DataFrame) -> DataFrame:
    """Items whose origin holds more than themselves."""
    size = origins.groupBy("origin_id").agg(F.count(F.lit(1)).alias("n"))
    return origins.join(size, "origin_id").select("item_id", (F.col("n") > 1).alias("echo"))


def latest_alert(events: DataFrame) -> DataFrame:
    """bubble_id and the grade of its newest fired event."""
    return events.where("alert_fired").groupBy("bubble_id").agg(F.max_by("to_grade", F.struct("at", "item_id")).alias("to_grade"))
