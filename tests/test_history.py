"""As-at reads from snapshots and the days since, against folding all members that were known."""

from datetime import date, datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from witness.operators import fold, history

SCHEMA = "item_id long, bubble_id long, source string, source_class string, occurred_at timestamp, captured_at timestamp, lat double, lng double"
T = datetime(2024, 1, 1)


def members(spark, n=600, days=12, start=0, seed=1):
    rng, rows = Random(seed), []
    for k in range(n):
        captured = T + timedelta(days=start, seconds=rng.randrange(86400 * days))
        lat = None if rng.random() < 0.2 else rng.uniform(-42, -41)
        occurred = None if rng.random() < 0.05 else captured - timedelta(minutes=rng.choice((0, 3, 50, 60, 61, 4000)))
        rows.append((k, rng.randrange(9), rng.choice(("a", "b", None)), rng.choice("xyz"), occurred, None if rng.random() < 0.02 else captured, lat, 174.7))
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    keep = ("bubble_id", "mass", "first_seen", "last_seen", "source_diversity", "source_classes", "velocity", "verified_by")
    return sorted((*(r[c] for c in keep), *(None if r[c] is None else round(r[c], 9) for c in ("lat", "lng"))) for r in df.collect())


@pytest.fixture(scope="module")
def some(spark):
    return members(spark).cache()


def same(spark, path, every, *times):
    for at in times:
        assert rows(history.refold_as_at(spark, path, at)) == rows(fold.refold_as_at(every, str(at)))


def test_equal_to_a_fold_of_all_members(spark, some, tmp_path):
    path = str(tmp_path)
    history.add(some, path)
    for day in (3, 6, 9):
        history.advance(spark, path, date(2024, 1, 1 + day))
    assert len(history.snapshots(spark, path)) == 3
    same(spark, path, some, T - timedelta(days=1), T + timedelta(days=2, hours=5), T + timedelta(days=3), T + timedelta(days=8, hours=23), T + timedelta(days=40))


def test_only_files_since_the_snapshot_are_read(spark, some, tmp_path):
    path = str(tmp_path)
    history.add(some, path)
    history.advance(spark, path, date(2024, 1, 8))
    old, rest = history._known(spark, path, date(2024, 1, 9))
    days = {r.f.split("day=")[1][:10] for r in rest.select(F.input_file_name().alias("f")).collect()}
    assert days == {"2024-01-08", "2024-01-09"}
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert old.count() < some.where("captured_at < '2024-01-08'").count() / 2


def test_late_members_undo_the_snapshots_that_miss_them(spark, some, tmp_path):
    path = str(tmp_path)
    history.add(some, path)
    for day in (4, 6, 8):
        history.advance(spark, path, date(2024, 1, day))
    late = members(spark, 40, 1, start=4, seed=2)  # captured on 5 January
    history.add(late, path)
    assert history.snapshots(spark, path) == [date(2024, 1, 4)]
    history.advance(spark, path, date(2024, 1, 8))
    same(spark, path, some.unionByName(late), T + timedelta(days=4, hours=12), T + timedelta(days=9))


def test_nothing_known(spark, some, tmp_path):
    path = str(tmp_path)
    history.add(some.limit(0), path)
    history.add(some, path)
    assert rows(history.refold_as_at(spark, path, datetime(2020, 1, 1))) == []
