"""Origins and verdicts after each arrival, in batch and as a stream, against a plain replay."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from witness import fixtures as X
from witness.operators import grade, origins
from witness.operators.graph import spanning_forest
from witness.operators.running import numbered, running
from witness.queries import QUERIES, evidence
from witness.streaming import streams

SF = "/root/testdata/sf0.001"


def replayed(rows, registry, crosses):
    """(bubble, item, items, origins, grade, alert worthy) after each arrival, with sets of linked items found anew each time."""
    url = lambda u: re.sub(r"/+$", "", re.sub(r"^https?://(www\.)?", "", u.strip().lower()))
    words = {r.item_id: set(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in rows}

    def linked(x, y):
        a, b = words[x.item_id], words[y.item_id]
        alike = a and b and len(a & b) >= 0.85 * len(a | b)
        quoted = (x.url and url(x.url) in map(url, y.quoted_urls)) or (y.url and url(y.url) in map(url, x.quoted_urls))
        return alike or quoted or (x.author and x.author.strip() and (x.source, x.author.strip().lower()) == (y.source, (y.author or "").strip().lower()))

    out = []
    for bubble in sorted({r.bubble_id for r in rows}):
        known, sets = [], []
        own = sorted((r for r in rows if r.bubble_id == bubble), key=lambda r: (r.captured_at, r.item_id))
        for r in own:
            joined = [s for s in sets if any(linked(r, o) for o in s)]
            sets = [s for s in sets if s not in joined] + [[r, *(o for s in joined for o in s)]]
            known.append(r)
            best = min((registry[x.source] for x in known if x.source in registry), default="F")
            placed, cross = any(x.lat is not None and x.lng is not None for x in known), crosses.get(bubble)
            c = 6 if not placed else 5 if cross == "inconsistent" else 4 - (len(sets) >= 2) - (cross == "consistent")
            c = 3 if c == 4 and best == "A" else c
            out.append((bubble, r.item_id, len(known), len(sets), f"{best}{c}", placed and cross != "inconsistent"))
    return out


def moved(verdicts):
    out, last = [], {}
    for bubble, item, n, n_origins, grade_now, worthy in verdicts:
        before, was = last.get(bubble, (None, False))
        if grade_now != before or (worthy and not was):
            out.append((bubble, item, before, grade_now, worthy, n, n_origins))
        last[bubble] = (grade_now, worthy)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def few(spark):
    """A later report that quotes two earlier ones makes three witnesses two, then one; an author's first report is
    captured after their second."""
    at = datetime(2024, 1, 1)
    row = lambda k, text, late, **kw: ("b", k, "live", kw.get("source", "s"), kw.get("author"), kw.get("url"), kw.get("quoted", []), text, at, at + timedelta(hours=late), kw.get("lat"), 1.0)
    rows = [
        row(1, "river over the road near the bridge", 1, url="https://a.org/1"),
        row(2, "wind took a roof off the hall", 2, url="https://www.A.org/2/", lat=1.0, source="src0"),
        row(3, "see both of these reports", 3, quoted=["http://a.org/1/", "a.org/2"]),
        row(4, "by ann", 9, author="Ann"),
        row(5, "more by the same person", 4, author=" ann"),
        row(6, "river over the road near the bridge", 5),
        row(7, "third thing by ann again", 10, author="ANN ", quoted=["https://a.org/1"]),
        row(8, None, 11),
        row(9, "", 12),
    ]
    schema = (
        "bubble_id string, item_id long, dataset_id string, source string, author string, url string, quoted_urls array<string>, text string,"
        " occurred_at timestamp, captured_at timestamp, lat double, lng double"
    )
    return spark.createDataFrame(rows, schema)


def test_origins_after_each_arrival_fall_where_sets_join(spark, few):
    checks = spark.createDataFrame([], "bubble_id string, cross_check string")
    got = grade.replay(few, X.registry(spark), checks, origins.merges(few)).orderBy("at", "item_id").collect()
    assert [r.origins for r in got] == [1, 2, 1, 2, 2, 2, 1, 2, 3]
    want = replayed(few.collect(), dict(X.REGISTRY), {})
    assert [(r.bubble_id, r.item_id, r["items"], r.origins, f"{r.reliability}{r.credibility}", r.alert_worthy) for r in got] == want


@pytest.fixture(scope="module")
def expected(spark):
    posts, checks = evidence.reports(spark, SF)
    return replayed(posts.collect(), dict(X.REGISTRY), {r.bubble_id: r.cross_check for r in checks.collect()})


def test_chained_transitions_equal_plain_replay(spark, expected):
    got = sorted((tuple(r) for r in QUERIES["o7_origins_by_arrival"](spark, SF).collect()))
    assert got == sorted(r[:4] for r in expected)
    assert sorted((tuple(r) for r in QUERIES["c15_chained_transitions"](spark, SF).collect()), key=str) == moved(expected)
    falls = sum(a[0] == b[0] and a[3] > b[3] for a, b in zip(expected, expected[1:], strict=False))
    assert falls


def test_stream_of_items_gives_the_same_transitions(spark, expected, tmp_path):
    """Half of the items are in the store, the rest come in three batches."""
    posts, checks = evidence.reports(spark, SF)
    order = [r.item_id for r in posts.orderBy("captured_at", "item_id").select("item_id").collect()]
    cuts = [0, 100, 140, 170, len(order)]
    parts = [posts.where(F.col("item_id").isin(order[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    path = str(tmp_path / "in")
    got = []
    known = spark.createDataFrame(parts[0].collect(), posts.schema)
    for part in parts[1:]:
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(posts.schema).parquet(path)
        q = (
            streams.witness_stream(stream, X.registry(spark), checks, known).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    before = set(order[:100])
    assert sorted(got, key=str) == [r for r in moved(expected) if r[1] not in before]


def test_forest_spans_at_every_weight(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), int(w)) for a, b, w in zip(*rng.integers(0, 60, (2, 150)), rng.integers(0, 9, 150), strict=True)]
    rows += [(k, k + 1, 5) for k in range(100, 140)] + [(200, k, 3) for k in range(201, 240)]
    got = [tuple(r) for r in spanning_forest(spark.createDataFrame(rows, "a long, b long, w int")).select("a", "b", "w").collect()]

    def sets(edges):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b, _ in edges:
            root[find(a)] = find(b)
        return len({find(x) for r in rows for x in r[:2]})

    for w in range(10):
        some = [e for e in got if e[2] <= w]
        assert sets(some) == sets([e for e in rows if e[2] <= w]) and len({x for r in rows for x in r[:2]}) - len(some) == sets(some)
    assert spanning_forest(spark.createDataFrame([], "a long, b long, w int")).count() == 0


def test_running_aggregates_over_chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{rng.integers(0, 3)}", int(t), None if rng.random() < 0.2 else int(rng.integers(0, 50))) for t in rng.permutation(300)]
    df = numbered(spark.createDataFrame(rows, "k string, t long, v int"), ["t"])
    got = running(df, ["k"], {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "n": ("sum", F.lit(1))}, chunk=7).collect()
    assert len(got) == 300
    for r in got:
        own = [v for k, t, v in rows if k == r.k and t <= r.t]
        seen = [v for v in own if v is not None]
        assert (r.s, r.lo, r.hi, r.n) == (sum(seen), min(seen, default=None), max(seen, default=None), len(own))
