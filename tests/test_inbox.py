"""The drop folder as a data source: whole reads, restarts without loss or repeats, routing."""

import json

import pytest
from pyspark.sql import functions as F

from witness.operators import adapt
from witness.sources import inbox

NOW = "2024-02-01 00:00:00"
FILES = {
    "a.json": '[{"text":"one"},{"text":" "}]',
    "b.json": '{"items":[{"text":"two"},{"text":"three"}]}',
    "c.json": '{"text":"four"}',
    "d.json": "{broken",
    "e.json": '[{"text":""}]',
}


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(inbox.Inbox)
    at = tmp_path / "in"
    at.mkdir()
    for name, text in FILES.items():
        (at / name).write_text(text)
    (at / "notes.txt").write_text("no report")
    return at


def told(rows):
    return adapt.adapt(rows, NOW).withColumn("verdict", F.when(F.coalesce("ok", F.lit(False)), "created").otherwise("failed"))


def test_a_batch_reads_all_files(spark, folder):
    rows = spark.read.format("inbox").load(str(folder)).collect()
    assert sorted((r.path, r.pos) for r in rows) == [("a.json", 0), ("a.json", 1), ("b.json", 0), ("b.json", 1), ("c.json", 0), ("d.json", -1), ("e.json", 0)]
    assert json.loads(next(r.payload for r in rows if r.path == "c.json")) == {"text": "four"}
    assert inbox.entries("[]") == [] and inbox.entries('"x"') is None and inbox.entries('{"items":3}') == ['{"items": 3}']


def run(spark, folder, state, seen, fail_on=None):
    def each(df, k):
        rows = told(df).select("path", "pos", "payload", "verdict").collect()
        if fail_on is not None and any(r.path == fail_on for r in rows):
            raise RuntimeError("crash before the batch is stored")
        for r in rows:
            seen.setdefault((r.path, r.pos), set()).add(k)
        inbox.route(spark.createDataFrame(rows, "path string, pos int, payload string, verdict string"), str(folder)) if rows else None

    stream = spark.readStream.format("inbox").option("most", 2).option("tasks", 2).load(str(folder))
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(state)).trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(300):
            if not inbox.waiting(str(folder)) or q.exception():
                break
            q.awaitTermination(0.2) if not q.exception() else None
    except Exception:
        assert fail_on
    finally:
        q.stop()


def test_a_restart_loses_and_repeats_nothing(spark, folder, tmp_path):
    seen = {}
    run(spark, folder, tmp_path / "state", seen, fail_on="c.json")
    assert ("a.json", 0) in seen and ("c.json", 0) not in seen
    (folder / "f.json").write_text('{"text":"late"}')
    run(spark, folder, tmp_path / "state", seen)
    assert set(seen) == {("a.json", 0), ("a.json", 1), ("b.json", 0), ("b.json", 1), ("c.json", 0), ("d.json", -1), ("e.json", 0), ("f.json", 0)}
    assert all(len(batches) == 1 for batches in seen.values())
    names = lambda f: sorted(x.name for x in (folder / f).iterdir())
    assert names("processed") == ["a.json", "b.json", "c.json", "f.json"] and names("failed") == ["d.json", "e.json"]
    assert not inbox.waiting(str(folder))
