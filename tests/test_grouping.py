"""Groups of bounded width, and grouping in order by parts, against plain loops."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from witness import fixtures as X
from witness.functions.geo import EARTH_M
from witness.operators import assign
from witness.queries import evidence


def metres(p, q):
    y1, x1, y2, x2 = *np.radians(p), *np.radians(q)
    return round(float(2 * EARTH_M * np.arcsin(np.sqrt(min(1, np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2)))), 3)


def centre(points):
    y, x = np.radians(points).T
    m = np.mean([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1)
    return np.degrees([np.arctan2(m[2], np.hypot(m[0], m[1])), np.arctan2(m[1], m[0])])


def split(at, links, gate):
    """item -> smallest item of its group."""

    def parts(members, edges):
        near = {i: set() for i in members}
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        left, out = set(members), []
        while left:
            seen, todo = set(), [min(left)]
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += near[i]
            out.append(sorted(seen))
            left -= seen
        return out

    todo, out = parts(list(at), links), {}
    while todo:
        g = todo.pop()
        c = centre([at[i] for i in g])
        far = max(g, key=lambda i: (metres(at[i], c), -i))
        if metres(at[far], c) <= gate:
            out |= dict.fromkeys(g, g[0])
            continue
        other = max(g, key=lambda i: (metres(at[i], at[far]), -i))
        side = {i: metres(at[i], at[far]) > metres(at[i], at[other]) for i in g}
        for s in (True, False):
            own = [i for i in g if side[i] == s]
            todo += parts(own, [(a, b) for a, b in links if side.get(a) == s and side.get(b) == s])
    return out


@pytest.fixture(scope="module")
def scattered(spark):
    """A chain of 20 points 1.1 km apart, a cloud, one across 180 degrees, and groups that need no split."""
    rng = np.random.default_rng(3)
    at = [(-41.0 + k * 0.01, 174.0) for k in range(20)]
    at += [(10 + y, 20 + x) for y, x in rng.uniform(0, 0.05, (60, 2))]
    at += [(-17.0, (179.98 + k * 0.01 + 180) % 360 - 180) for k in range(6)]
    at += [(50 + y, 5 + x) for y, x in rng.uniform(0, 0.004, (10, 2))]
    rows = [(k, "d", float(y), float(x)) for k, (y, x) in enumerate(at)] + [(500, "d", None, None)]
    df = spark.createDataFrame(rows, "item_id long, dataset_id string, lat double, lng double")
    return df.withColumns({"occurred_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("item_id")), "v": F.array(F.lit(1.0), F.lit(0.5))}), {k: p for k, p in enumerate(at)}


def test_groups_reach_no_farther_than_the_gate(scattered):
    items, at = scattered
    links = [(a, b) for a in at for b in at if a < b and metres(at[a], at[b]) <= 1500]
    want = split(at, links, 1500.0)
    got = {r.item_id: r.group_id for r in assign.group_batch(items).collect()}
    assert {i: got[i] for i in at} == want and got.keys() == at.keys() | {500}
    for g, n in Counter(want.values()).items():
        c = centre([at[i] for i in at if want[i] == g])
        assert n == 1 or max(metres(at[i], c) for i in at if want[i] == g) <= 1500
    assert len({want[i] for i in range(20)}) > 5 and len({want[i] for i in range(86, 96)}) == 1


def test_groups_of_the_items_are_narrow(spark):
    items = evidence._with_vectors(spark, "/root/testdata/sf0.001")
    rows = items.join(assign.group_batch(items, threshold=0.2), "item_id").where("lat IS NOT NULL").collect()
    assert X.items(spark, "/root/testdata/sf0.001").count() == items.count()
    groups = {}
    for r in rows:
        groups.setdefault(r.group_id, []).append((r.lat, r.lng))
    assert max(metres(p, centre(g)) for g in groups.values() for p in g) <= 1500 and max(map(len, groups.values())) > 2


def in_order(rows, threshold, gate, hours=6, limit=50):
    """item -> group, one item after the other."""
    out, live = {}, {}
    for r in sorted((r for r in rows if r.occurred_at), key=lambda r: (r.dataset_id, r.occurred_at, r.item_id)):
        if r.dataset_id not in live:
            live[r.dataset_id] = assign.LiveBubbles(threshold, gate, hours, limit)
        out[r.item_id] = live[r.dataset_id].place(r.item_id, r.occurred_at.timestamp(), np.asarray(r.v, float), r.lat, r.lng)[0]
    return out | {r.item_id: r.item_id for r in rows if not r.occurred_at}


@pytest.mark.parametrize(("threshold", "part", "limit"), [(0.2, 64, 50), (0.9, 100, 50), (0.75, 37, 3)])
def test_grouping_in_parts_equals_grouping_in_order(spark, threshold, part, limit):
    """Parts that begin right and parts that are grouped again; items without a place or a time, two data sets."""
    df = evidence._with_vectors(spark, "/root/testdata/sf0.001").where("item_id < 400")
    df = df.withColumn("occurred_at", F.when(F.col("item_id") % 41 > 0, F.expr("occurred_at + make_interval(0, 0, 0, -pmod(item_id, 29))")))
    items = spark.createDataFrame(df.collect(), df.schema)
    want = in_order(items.collect(), threshold, 1500.0, limit=limit)
    got = {r.item_id: r.group_id for r in assign.group_in_order(items, threshold, limit=limit, part=part).collect()}
    assert got == want and 1 < len(set(got.values())) < len(got)


def test_wrong_parts_are_run_on_at_once(spark, monkeypatch):
    """Two long-lived bubbles, each over many parts: one run after the first, which passes over the parts that were right."""
    rng = np.random.default_rng(5)
    same = rng.normal(size=32)
    long_lived = [*range(40, 100), *range(200, 260)]
    rows = [(k, "d", -41.0, 174.0, (same if k in long_lived else rng.normal(size=32)).tolist()) for k in range(320)]
    df = spark.createDataFrame(rows, "item_id long, dataset_id string, lat double, lng double, v array<double>")
    items = df.withColumn("occurred_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("item_id") * 600))
    runs, redone, first, on = [], [], assign._run_parts, getattr(assign, "_run_on", None)

    def run_on(*args):
        out = on(*args)
        redone.append({r.part for r in out.select("part").distinct().collect()})
        return out

    monkeypatch.setattr(assign, "_run_parts", lambda *args: runs.append(1) or first(*args))
    monkeypatch.setattr(assign, "_run_on", run_on, raising=False)
    got = {r.item_id: r.group_id for r in assign.group_in_order(items, 0.75, 1500.0, 1, 50, part=8).collect()}
    assert got == in_order(items.collect(), 0.75, 1500.0, hours=1)
    assert len(runs) == len(redone) == 1
    # Parts are numbered from 0, if one range holds all; those between the two bubbles are right as they were.
    assert 5 < len(redone[0]) < 25 and max(redone[0]) - min(redone[0]) > len(redone[0])


@pytest.mark.parametrize("block", [7, 1 << 12])
def test_crowded_places_give_the_same_groups(spark, block):
    """Links that merely connect the nodes of two places: the groups of all links, parted or not."""
    items = evidence._with_vectors(spark, "/root/testdata/sf0.001")
    more = items.withColumns({"item_id": F.col("item_id") + 5000, "occurred_at": F.expr("occurred_at + make_interval(0, 0, 0, 0, 0, 0, pmod(item_id * 7919, 90000))"), "v": F.transform("v", lambda x: x * 1.5 - 0.02)})
    items = items.unionByName(more)
    want = {r.item_id: r.group_id for r in assign.group_batch(items, threshold=0.2, crowded=1 << 60).collect()}
    got = {r.item_id: r.group_id for r in assign.group_batch(items, threshold=0.2, crowded=0, block=block).collect()}
    assert got == want and 1 < len(set(got.values())) < len(got)


def test_links_of_crowded_places_are_fewer_than_pairs(spark):
    """400 items of a place and time with vectors of their own are 79,800 pairs and 399 links."""
    rng = np.random.default_rng(2)
    rows = [(k, "d", -41.0, 174.0, (1 + rng.uniform(0, 0.1, 4)).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "item_id long, dataset_id string, lat double, lng double, v array<double>")
    items, held, made = df.withColumn("occurred_at", F.timestamp_seconds(F.lit(1_700_000_000))), assign._node_links, []
    assign._node_links = lambda *args: made.append(held(*args)) or made[0]
    try:
        assert {r.group_id for r in assign.group_batch(items).collect()} == {0}
    finally:
        assign._node_links = held
    assert made[0].count() == 399


def test_alike_by_matrix_is_the_cosine():
    """At the threshold, without length, of other lengths, with gaps."""
    import pyarrow as pa

    for rows in ([[1.0, 0.0], [3.0, 4.0], [0.0, 0.0], [0.6, 0.8], [4.0, 3.0]], [[1.0, 0.0], [3.0], None, [3.0, 4.0], [None, 1.0], []]):
        v, at = pa.array(rows, pa.list_(pa.float64())), np.arange(len(rows))
        for threshold in (0.6, 0.0, 0.96):
            i, j = (x.ravel() for x in np.meshgrid(at, at, indexing="ij"))
            want = ~(assign._cosines(v.take(pa.array(i)), v.take(pa.array(j))) < threshold)
            assert (assign._alike(v, at, at, threshold).ravel() == want).all()
