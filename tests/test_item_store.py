"""Intake by several writers: batches that come again, tries that failed, and what a batch reads."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest

from witness.sources.item_store import ItemStore

SCHEMA = "dataset_id string, source string, external_id string, item_id long, captured_at timestamp, text string"
T = datetime(2024, 1, 1)


def rows_of(spark, *keys, dataset="d", start=0):
    rows = [(dataset, "s", None if k is None else str(k), start + i, T + timedelta(minutes=start + i), f"t{k}") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def made(spark, tmp_path):
    schema = rows_of(spark, 1).schema
    return lambda: ItemStore(spark, str(tmp_path / "store"), schema)


def keys(store):
    return sorted((r.dataset_id, r.external_id or "", r.item_id) for r in store.read().collect())


def test_a_batch_that_comes_again_adds_nothing(spark, made):
    store = made()
    assert keys(store) == []
    assert store.add("q-0", rows_of(spark, 1, 2, 2, None, None))
    assert not store.add("q-0", rows_of(spark, 1, 2, 2, None, None))
    assert store.add("q-1", rows_of(spark, 2, 3, start=100))
    assert keys(store) == [("d", "", 3), ("d", "", 4), ("d", "1", 0), ("d", "2", 1), ("d", "3", 101)]
    assert store.add("q-2", rows_of(spark, 1)) and store.add("q-3", rows_of(spark))  # nothing new, nothing at all
    assert len(keys(store)) == 5


def test_writers_at_one_time_lose_and_double_nothing(spark, made):
    def write(k):
        return [made().add(f"w{k}-{b}", rows_of(spark, *range(b * 10, b * 10 + 15), start=1000 * k + 100 * b)) for b in range(3)]

    with ThreadPoolExecutor(4) as pool:
        assert all(all(x) for x in pool.map(write, range(4)))
    got = keys(made())
    assert sorted(int(k) for _, k, _ in got) == list(range(35))
    # The first by time: the first writer's, of batches that share keys the earlier.
    assert {int(k): i for _, k, i in got} == {k: min(100 * b + k - 10 * b for b in range(3) if 0 <= k - 10 * b < 15) for k in range(35)}
    assert made().merge() and keys(made()) == got
    assert len(made().sweep()) == 12 and keys(made()) == got
    assert not made().add("w0-0", rows_of(spark, 99)) and keys(made()) == got


def test_two_tries_at_one_batch(spark, made):
    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(lambda k: made().add("same", rows_of(spark, 1, 2, start=10 * k)), range(3)))
    assert sum(won) == 1 and [k for _, k, _ in keys(made())] == ["1", "2"]


def test_what_a_lost_writer_left_is_not_read(spark, made, monkeypatch):
    store = made()
    store.add("a", rows_of(spark, 1))

    def lost(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(ItemStore, "_mark", lost)
        with pytest.raises(OSError):
            store.add("b", rows_of(spark, 2, 3))
    assert [k for _, k, _ in keys(store)] == ["1"]
    assert store.add("b", rows_of(spark, 2, 3)) and [k for _, k, _ in keys(store)] == ["1", "2", "3"]
    assert len(store.sweep()) == 1 and len(keys(store)) == 3


def test_a_batch_opens_only_files_its_keys_can_be_in(spark, made):
    from pyspark.sql import functions as F

    store = made()
    store.add("a", rows_of(spark, *range(500)))
    store.add("b", rows_of(spark, *range(500), dataset="e"))
    batch = rows_of(spark, 7).withColumn("_what", F.lit("id:7")).withColumn("shard", F.pmod(F.xxhash64("dataset_id", "source", "_what"), F.lit(64)).cast("int"))
    shard = batch.first().shard
    found = store.stored_keys(batch)
    read = {r.f for r in found.select(F.input_file_name().alias("f")).collect()}
    assert len(read) == 1 and f"dataset_id=d/shard={shard}/" in read.pop()
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "dataset_id" in filters and "shard" in filters and "folder" in filters


def test_a_stream_that_restarts_stores_each_item_once(spark, made, tmp_path):
    at = str(tmp_path / "in")
    rows_of(spark, *range(20), None, None).write.parquet(at)
    for name in ("one", "two", "one"):  # another query over the same files, and the first again without its checkpoint
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(at)
        put = stream.writeStream.foreachBatch(lambda df, n, name=name: made().add(f"{name}-{n}", df) and None)
        put.option("checkpointLocation", str(tmp_path / f"c-{name}-{len(made().marks())}")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(keys(made())) == 22
