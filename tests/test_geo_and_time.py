"""Joins by place on the whole globe, and reads as at a time."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from witness.functions import geo
from witness.operators import assign, origins, spatial, store, trust
from witness.plans import reads

# ---------------------------------------------------------------- the globe

PLACES = [(-41.0, 174.7), (0.0, 0.0), (70.0, 25.0), (85.0, -60.0), (-17.0, 180.0), (52.0, -180.0), (89.99, 10.0), (-90.0, 0.0)]


@pytest.fixture(scope="module")
def globe(spark):
    """Groups of points within some kilometres at every latitude, across 180 degrees and round the poles."""
    rng = np.random.default_rng(7)
    rows = []
    for lat, lng in PLACES:
        for dy, dx in rng.uniform(-1, 1, (60, 2)):
            y = max(-90.0, min(90.0, lat + dy * 0.03))
            x = lng + (dx * 0.03 / max(np.cos(np.radians(y)), 1e-4))
            rows.append((float(y), float((x + 180) % 360 - 180)))
    rows += [(-17.0, 180.0), (-17.0, -180.0), (None, 3.0), (3.0, None)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "item_id long, lat double, lng double").withColumns({
        "dataset_id": F.lit("d"), "hazard": F.lit("h"), "occurred_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("item_id") * 7), "url": F.lit(None).cast("string"), "author": F.lit(None).cast("string"),
        "source_class": F.lit("c"), "quoted_urls": F.array().cast("array<string>"), "value": F.lit(1.0), "v": F.array(F.lit(1.0)), "bubble_id": F.col("item_id").cast("string"),
    }).cache()


def within(globe, metres):
    p = [(r.item_id, r.lat, r.lng) for r in globe.collect() if r.lat is not None and r.lng is not None]
    i, y, x = np.array([r[0] for r in p]), np.radians([r[1] for r in p]), np.radians([r[2] for r in p])
    h = np.sin((y - y[:, None]) / 2) ** 2 + np.cos(y) * np.cos(y[:, None]) * np.sin((x - x[:, None]) / 2) ** 2
    near = 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h))) <= metres
    return {(int(i[a]), int(i[b])) for a, b in zip(*np.nonzero(near), strict=True)}


@pytest.mark.parametrize("metres", [200.0, 1500.0, 40_000.0])
def test_pairs_by_cell_equal_all_pairs(globe, metres):
    want = within(globe, metres)
    assert {tuple(r) for r in trust.related(globe, metres).select("a", "b").collect()} == {(a, b) for a, b in want if a != b}
    assert {tuple(r) for r in assign.near_pairs(globe, metres).select("a_item_id", "b_item_id").collect()} == {(a, b) for a, b in want if a < b}
    bubbles = globe.withColumns({"first_seen": F.col("occurred_at"), "last_seen": F.col("occurred_at")})
    got = store.candidates(globe, bubbles, metres=metres, candidate_limit=None).where("metres IS NOT NULL").select("item_id", F.col("bubble_id").cast("long"))
    assert {tuple(r) for r in got.collect()} == want
    got = spatial.reports_near(globe.select(F.col("item_id").alias("place"), "lat", "lng"), globe, metres)
    assert {r.place: r.n for r in got.collect()} == {k: sum(a == k for a, _ in want) for k in {a for a, _ in want}}


def test_distance_is_unknown_without_a_place(globe):
    unplaced = globe.where("lat IS NULL OR lng IS NULL")
    assert {r[0] for r in unplaced.select(geo.haversine_m(F.col("lat"), F.col("lng"), F.lit(1.0), F.lit(1.0))).collect()} == {None}
    # An item without a place meets every open bubble.
    bubbles = globe.withColumns({"first_seen": F.col("occurred_at"), "last_seen": F.col("occurred_at")})
    assert store.candidates(unplaced, bubbles, candidate_limit=5).groupBy("item_id").count().agg(F.min("count"), F.max("count")).first() == (5, 5)
    centre = reads.located(globe.withColumn("bubble_id", F.lit("b")).where("item_id < 60 OR lat IS NULL")).first()
    assert centre.radius_m < 10_000


def test_a_circle_meets_few_cells(globe):
    for metres in (200.0, 1500.0):
        met = geo.around(globe.where("abs(lat) < 86"), metres, "c").groupBy("item_id").count()
        assert met.agg(F.max("count")).first()[0] <= 12


# ---------------------------------------------------------------- as at a time

T = "the river has come over the road at the old school bridge today"
WIND = "a gust took the roof of the hall and dropped it on the playing field"


def _member(k, day, text, quoted=(), url=None, author=None):
    at = datetime(2024, 1, day, k)
    return ("b", k, "live", "s", author, url, list(quoted), text, at, at, -41.0, 174.0, 1.0, False)


@pytest.fixture(scope="module")
def reports(spark):
    """Two reports of 1 January; one of 3 January quotes both and makes them one witness. One author's first report is
    captured last."""
    schema = (
        "bubble_id string, item_id long, dataset_id string, source string, author string, url string, quoted_urls array<string>, text string, occurred_at timestamp,"
        " captured_at timestamp, lat double, lng double, geo_confidence double, assumed_time boolean"
    )
    rows = [_member(1, 1, T, url="https://a.org/1"), _member(2, 1, WIND, url="https://a.org/2"), _member(3, 3, "see both", quoted=["https://a.org/1", "https://a.org/2"])]
    return spark.createDataFrame(rows, schema).withColumn("source_class", F.lit("c"))


EVENTS = "bubble_id string, item_id long, at timestamp, reliability string, credibility int, to_grade string"


def test_reads_as_at_do_not_use_later_links(spark, reports):
    events = spark.createDataFrame([], EVENTS)
    grades = spark.createDataFrame([("b", "F", 3)], "bubble_id string, reliability string, credibility int")
    for as_at, n, n_origins in (("2024-01-02 00:00:00", 2, 2), ("2024-01-04 00:00:00", 3, 1), (None, 3, 1)):
        detail = reads.signal_detail(reports, origins.linked_origins, events, "b", as_at).first()
        assert (detail["items"], detail.independent_sources) == (n, n_origins), as_at
        rows = {r.item_id: r.origin_id for r in reads.provenance(reports, origins.linked_origins, "b", as_at).collect()}
        assert rows == ({1: 1, 2: 2} if n == 2 else {1: 1, 2: 1, 3: 1})
        placed, _ = reads.map_layer(reports, origins.linked_origins, grades, "2024-01-05 00:00:00", None, as_at=as_at, events=events)
        shown = placed.first()
        assert (shown.mass, shown.independent_sources) == (n, n_origins), as_at
