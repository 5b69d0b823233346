"""Points in areas by cells, against the even-odd rule over all sides."""

from math import cos, pi, sin
from random import Random

import pytest
from pyspark.sql import functions as F

from witness.operators import cover, spatial

EDGES = "layer string, area string, x1 double, y1 double, x2 double, y2 double"


def ring(rng, x, y, size, n):
    turned = sorted(rng.uniform(0, 2 * pi) for _ in range(n))
    spots = [(x + size * rng.uniform(0.3, 1) * cos(t), y + size * rng.uniform(0.3, 1) * sin(t)) for t in turned]
    return list(zip(spots, spots[1:] + spots[:1], strict=True))


def even_odd(p, sides):
    lng, lat = p
    return sum((y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in sides) % 2 == 1


def plain(points, edges):
    areas = {}
    for layer, area, *side in edges:
        areas.setdefault((layer, area), []).append(side)
    return {(k, *name) for k, x, y in points if x is not None and y is not None for name, sides in areas.items() if even_odd((x, y), sides)}


def got(spark, points, edges, most):
    p = spark.createDataFrame(points, "id long, lng double, lat double")
    found = spatial.inside(p, spark.createDataFrame(edges, EDGES), most).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_random_rings_with_holes(spark):
    rng = Random(5)
    edges = []
    for k in range(6):
        x, y, size = 174.7 + rng.uniform(-0.1, 0.1), -41.3 + rng.uniform(-0.1, 0.1), rng.choice((0.02, 0.1, 0.9))
        for part in (1.0, 0.4, 0.25):  # outer ring, a hole, an island in it, which may cross each other
            edges += [("l" + str(k % 2), f"a{k}", *a, *b) for a, b in ring(rng, x, y, size * part, rng.choice((3, 12, 150)))]
    points = [(i, 174.7 + rng.uniform(-1, 1) * s, -41.3 + rng.uniform(-1, 1) * s) for i, s in enumerate(rng.choice((0.02, 0.1, 0.9)) for _ in range(3000))]
    points += [(5000, None, -41.3), (5001, 174.7, None), (5002, *points[0][1:])]
    want = plain(points, edges)
    assert len(want) > 1000
    assert got(spark, points, edges, 0) == want == got(spark, points, edges, 10**6)


def test_corners_and_sides_on_the_lines_of_the_grid(spark):
    """Everything on multiples of half a cell: vertices on corners, sides along lines, points on both."""
    rng, half = Random(6), cover.STEP / 2
    edges = []
    for k in range(12):
        spots = [(rng.randrange(-9, 10) * half, rng.randrange(-9, 10) * half) for _ in range(rng.choice((3, 4, 7)))]
        edges += [("l", f"a{k}", *a, *b) for a, b in zip(spots, spots[1:] + spots[:1], strict=True)]
    points = [(i * 40 + j, (i - 20) * half / 2, (j - 20) * half / 2) for i in range(40) for j in range(40)]
    assert got(spark, points, edges, 0) == plain(points, edges)


def test_areas_beyond_180_hold_points_a_turn_away(spark):
    square = [(179.0, -45.0), (182.0, -45.0), (182.0, -44.0), (179.0, -44.0)]
    west = [(-181.0, 10.0), (-179.0, 10.0), (-179.0, 11.0), (-181.0, 11.0)]
    edges = [("l", n, *a, *b) for n, r in (("east", square), ("west", west)) for a, b in zip(r, r[1:] + r[:1], strict=True)]
    points = [(1, 179.5, -44.5), (2, -178.5, -44.5), (3, -177.5, -44.5), (4, 181.5, -44.5), (5, 179.5, 10.5), (6, -179.5, 10.5), (7, 178.5, 10.5)]
    for most in (0, 100):
        assert got(spark, points, edges, most) == {(1, "l", "east"), (2, "l", "east"), (4, "l", "east"), (5, "l", "west"), (6, "l", "west")}


@pytest.mark.parametrize("most", [0, -1])
def test_no_areas_no_points(spark, most):
    assert got(spark, [(1, 1.0, 1.0)], [], most) == set()
    assert got(spark, [], [("l", "a", 0.0, 0.0, 1.0, 1.0)], most) == set()


def test_an_inner_point_meets_a_run_and_no_side(spark):
    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    edges = spark.createDataFrame([("l", "a", *a, *b) for a, b in zip(box, box[1:] + box[:1], strict=True)], EDGES)
    sides = cover.border(edges, ["layer", "area"])
    corners = cover.parities(sides, ["layer", "area"])
    inner = cover.runs(corners, ["layer", "area"])
    cells = inner.agg(F.sum(F.least("_to", (F.col("_block") + 1) * cover.RUN - 1) - F.greatest("_from", F.col("_block") * cover.RUN) + 1)).first()[0]
    assert cells > 0.95 * (2 / cover.STEP) ** 2
    assert sides.count() < 10 * 2 / cover.STEP
