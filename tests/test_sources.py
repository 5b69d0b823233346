"""The adapter, the drop folder, text rules, grouping and the streams."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from witness import fixtures as X
from witness.functions import text as T
from witness.functions import vectors as V
from witness.operators import adapt as A
from witness.operators import assign, fold, grade, spatial, store
from witness.queries import evidence
from witness.sources import drop_folder
from witness.streaming import streams

NOW = "2024-02-01 00:00:00"
SF = "/root/testdata/sf0.001"


def adapted(spark, *payloads):
    rows = [(k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)]
    return [r for r in A.adapt(spark.createDataFrame(rows, "k long, payload string"), NOW).orderBy("k").collect()]


def notes(row):
    return {a.key: a.value for a in row.annotations}


def test_payloads_of_many_shapes(spark):
    got = adapted(
        spark,
        {"title": "Slip.", "text": "Road is shut", "source": "wcc", "timestamp": 1706700000, "lat": "-41.3", "lng": 174.8, "depth_m": 3, "tags": ["a", "b"]},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [174.7, -41.2]}, "properties": {"station": "Aro", "stage_m": 1.2}},
        '"just words"',
        [1, 2],
        {"text": "   "},
        {"text": "half", "lat": -41.2},
        {"text": "far", "lat": 99, "lng": 10, "observed_at": "2024-01-05T00:00:00Z"},
        {"author": "ann", "body": "post", "url": "https://ex.org/1", "quoted_urls": ["u1", " "], "synthetic": "1", "annotations": [{"key": "hazard", "value": "fire", "confidence": 0.6}]},
        "not json",
        {"text": "x" * 5000},
    )
    a, b, c, d, e, f, g, h, i, j = got
    assert (a.ok, a.text, a.source, a.lat, a.lng, a.geo_confidence) == (True, "Slip — Road is shut", "wcc", -41.3, 174.8, 1.0)
    assert a.occurred_at == datetime.fromtimestamp(1706700000) and not a.assumed_time and notes(a)["depth_m"] == "3"
    assert [x.value for x in a.annotations if x.key == "tag"] == ["a", "b"]
    assert b.text == "type: Feature; station: Aro; stage m: 1.2" and (b.lat, b.lng) == (-41.2, 174.7) and b.assumed_time
    assert c.ok and c.text == "just words" and not d.ok and not e.ok and "text" in e.reason and not i.ok
    assert f.ok and f.lat is None and f.geo_dropped.startswith("incomplete coordinates") and g.geo_dropped.startswith("coordinates out of range")
    assert (h.source, h.author, h.url, h.quoted_urls, h.synthetic) == ("ann", None, "https://ex.org/1", ["u1"], True)
    assert notes(h)["hazard"] == "fire" and notes(h)["source_url"] == "https://ex.org/1" and notes(h)["synthetic"] == "true"
    assert len(j.text) == 4001 and notes(j)["text_truncated"] == "true"


def test_values_are_told_apart_by_type_and_nothing_is_lost(spark):
    got = adapted(
        spark,
        {"text": "[bracket] start of a report", "title": "{curly} title", "k": "[1] first", "n": 1.5, "yes": True, "none": None, "deep": {"x": 1}, "list": [1]},
        {"text": "t", "annotations": {"hazard": "fire", "deep": {}, "n": 2}, "tags": {"sev": "high", "list": []}},
        {"text": "t", "annotations": "note", "tags": "one"},
        {"text": "t", "annotations": ["free", 3, None, [1], {"key": " k ", "value": {"a": 1}, "confidence": 7, "annotator": ""}, {"key": 5, "value": "x"}], "tags": ["a", 2, {"b": 1}]},
        {"annotations": "only", "meta": "scalar"},
        {"text": "t", "link": "https://a.org", "source_url": "https://b.org", "quoted_urls": ["u", 5, "[v]"]},
        {"text": "t", "quoted_url": "[not json", "author": "ann", "user": "bob"},
        {"text": ["x"], "body": "second alias", "meta": {"body": "inner", "k": "[in]", "station": 7}, "metadata": {"k": "later", "more": "m"}},
    )
    a, b, c, d, e, f, g, h = got
    assert a.text == "{curly} title — [bracket] start of a report"
    assert {k: v for k, v in notes(a).items() if k != "assumed_occurred_at"} == {"k": "[1] first", "n": "1.5", "yes": "true"}
    assert {k: v for k, v in notes(b).items() if k != "assumed_occurred_at"} == {"hazard": "fire", "n": "2", "sev": "high"}
    assert [(x.key, x.value) for x in c.annotations][:2] == [("annotation", "note"), ("tag", "one")]
    assert [(x.key, x.value, x.confidence, x.annotator) for x in d.annotations][:5] == [
        ("annotation", "free", None, "feed"), ("annotation", "3", None, "feed"), ("k", '{"a":1}', None, "feed"), ("tag", "a", None, "feed"), ("tag", "2", None, "feed")
    ]
    assert d.annotations[5].key == "assumed_occurred_at"
    assert e.ok and e.text == "annotations: only; meta: scalar" and notes(e)["annotation"] == "only" and notes(e)["meta"] == "scalar"
    assert f.url == "https://a.org" and f.quoted_urls == ["u", "[v]"] and [x.value for x in f.annotations if x.key == "source_url"] == ["https://b.org"]
    assert g.quoted_urls == ["[not json"] and g.source == "ann" and g.author == "bob"
    assert h.text == "second alias" and notes(h)["k"] == "[in]" and notes(h)["station"] == "7" and notes(h)["more"] == "m"


def test_keys_written_twice_and_numbers_beyond_doubles(spark):
    got = adapted(
        spark,
        '{"text":"dup","k":"1","text":"dup2","k":2}',
        '{"text":"t","big":1e400,"low":-1e400,"meta":{"big":3,"deep":"a","deep":"b"}}',
        '{"station":"x","level":1,"station":"y"}',
    )
    a, b, c = got
    assert a.text == "dup2" and notes(a)["k"] == "2"
    assert (notes(b)["big"], notes(b)["low"], notes(b)["deep"]) == ("Infinity", "-Infinity", "b")
    assert c.text == "station: y; level: 1"


def test_only_real_nuls_are_stripped(spark):
    got = adapted(spark, '{"text":"a\\u0000\\u0000b"}', '{"text":"a\\\\u0000b"}', '{"te\\u0000xt":"c\\\\\\u0000d"}')
    assert [r.text for r in got] == ["ab", "a\\u0000b", "c\\d"]
    assert ["nul_bytes_stripped" in notes(r) for r in got] == [True, False, True]


def test_terms_are_found_once_in_their_order(spark):
    rows = spark.createDataFrame([("Flooding in TAWA and tawa, Karori",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(T.hits(F.col("t"), ("Tawa", "Karori", "Ngaio"))).collect()] == [["Tawa", "Karori"], [], []]


def test_drop_folder_as_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('[{"text":"one"},{"text":" "}]')
    (folder / "b.json").write_text('{"items":[{"text":"two"}]}')
    (folder / "c.json").write_text('{"text":"three"}')
    (folder / "d.json").write_text("{broken")
    (folder / "e.json").write_text('[{"text":""}]')
    read = drop_folder.read_drop_folder(spark, str(folder))
    told = A.adapt(read, NOW).withColumn("verdict", F.when(F.coalesce("ok", F.lit(False)), "created").otherwise("failed"))
    got = {r.path.rsplit("/", 1)[1][0]: r.folder for r in drop_folder.route_files(told).collect()}
    assert got == {"a": "processed", "b": "processed", "c": "processed", "d": "failed", "e": "failed"}
    out = drop_folder.stream_drop_folder(spark, str(folder)).writeStream.format("memory").queryName("dropped").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.table("dropped").where("pos >= 0").count() == 5


def test_text_rules(spark):
    rows = spark.createDataFrame([("Blockage 19 Pringle Street, 50 mm main",), ("Fault 19A-21 THE TERRACE",), ("2/14 High Street",)], "t string")
    assert [r[0] for r in rows.select(T.redact_house_numbers(F.col("t"))).collect()] == ["Blockage Pringle Street, 50 mm main", "Fault THE TERRACE", "High Street"]
    words = spark.createDataFrame([("coastal inundation",), ("inundat",), ("Flooding at Wellington Central",), (None,)], "t string")
    assert [r[0] for r in words.select(T.hazard_of(F.col("t"))).collect()] == ["coastal", "flooding", "flooding", "other"]
    assert words.select(T.place_of(F.col("t"))["place"]).collect()[2][0] == "wellington central"


def test_lexical_embedding_agrees_with_plain_code(spark):
    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return h

    text = "Flooding flooded the streets; trees down"
    tokens = ["flood", "flood", "street", "tree", "down"]
    want = {}
    for f in tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False)]:
        for j in range(2):
            i = fnv(f"{f}#{j}") % V.DIMENSIONS
            want[i] = want.get(i, 0) + (1 if fnv(f"{f}${j}") % 2 == 0 else -1)
    want = {i: w for i, w in want.items() if w}
    norm = sum(w * w for w in want.values()) ** 0.5
    sparse = V.sparse_embedding(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t")
    assert {r.i: round(r.w, 9) for r in sparse.collect()} == {i: round(w / norm, 9) for i, w in want.items()}
    dense = V.dense_embedding(sparse, "k").first().embedding
    assert len(dense) == V.DIMENSIONS and abs(sum(x * x for x in dense) - 1) < 1e-9


def test_polygons_with_holes(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6)]
    rows = [("a", float(x1), float(y1), float(x2), float(y2)) for ring in (square, hole) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)]
    edges = spark.createDataFrame(rows, "area string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0), (4, 5.0, 7.0), (5, None, 1.0)], "id long, lng double, lat double")
    for most in (10, 0):  # broadcast and joined
        assert sorted(r.id for r in spatial.inside(points, edges, most).collect()) == [1, 4]


def test_batch_grouping_attaches_loose_items_without_chaining(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "d", t, -41.3, 174.7, [1.0, 0.0]), (2, "d", t, -41.301, 174.7, [1.0, 0.1]), (3, "d", t, -41.2, 174.7, [1.0, 0.0]), (4, "d", t, None, None, [1.0, 0.05]), (5, "d", t, None, None, [0.0, 1.0]), (6, "e", t, -41.3, 174.7, [1.0, 0.0])]
    items = spark.createDataFrame(rows, "item_id long, dataset_id string, occurred_at timestamp, lat double, lng double, v array<double>")
    got = {r.item_id: r.group_id for r in assign.group_batch(items).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}
    serial = {r.item_id: r.group_id for r in assign.group_in_order(items).collect()}
    assert serial[1] == serial[2] == serial[4] and serial[3] == 3 and serial[6] == 6


# ---------------------------------------------------------------- streams


@pytest.fixture()
def item_stream(spark, tmp_path):
    items = X.items(spark, SF).where("external_id IS NOT NULL").select("item_id", "dataset_id", "source", "external_id", "captured_at", "occurred_at")
    path = str(tmp_path / "items")
    items.unionByName(items.where("item_id % 3 = 1")).coalesce(1).write.parquet(path)
    return items, spark.readStream.schema(items.schema).parquet(path)


def test_redeliveries_go_once(spark, item_stream):
    items, stream = item_stream
    q = streams.once(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == items.select("dataset_id", "source", "external_id").distinct().count()


def test_foreach_batch_append_is_idempotent(spark, item_stream, tmp_path):
    items, stream = item_stream
    path = str(tmp_path / "store")
    for _ in range(2):
        q = stream.writeStream.foreachBatch(lambda df, _: streams.append_new(df, path)).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.parquet(path).count() == items.select("dataset_id", "source", "external_id").distinct().count()


def test_tumbling_counts_batch_equals_stream(spark, item_stream):
    items, stream = item_stream
    q = streams.tumbling_counts(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == items.count() + items.where("item_id % 3 = 1").count()


def _vectors_in_order(spark):
    rng = np.random.default_rng(6)
    t, rows = datetime(2024, 1, 1), []
    for k in range(150):
        t += timedelta(minutes=int(rng.integers(1, 90)) if k % 40 else 24 * 60)
        placed = k % 5 > 0
        at = (-41.3 + 0.01 * int(rng.integers(0, 4)), 174.7) if placed else (None, None)
        rows.append((k, "ab"[k % 7 == 0], t, *at, [float(x) for x in rng.normal(size=3) + 2 * np.eye(3)[rng.integers(0, 3)]]))
    return rows, "item_id long, dataset_id string, occurred_at timestamp, lat double, lng double, v array<double>"


def test_stream_grouping_equals_the_batch_in_order(spark, tmp_path):
    rows, schema = _vectors_in_order(spark)
    want = {r.item_id: r.group_id for r in assign.group_in_order(spark.createDataFrame(rows, schema)).collect()}
    assert 10 < len(set(want.values())) < 120
    for k in range(3):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streams.group_stream(stream).writeStream.format("memory").queryName("grouped").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.item_id: r.bubble_id for r in spark.table("grouped").collect()}
    assert got == want


def test_live_bubbles_gate_distance_count_and_time():
    live = assign.LiveBubbles(0.5, 1500.0, 6, 2)
    v, w = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert live.place(1, 0.0, v, -41.3, 174.7) == (1, -2.0)
    assert live.place(2, 60.0, v, -41.2, 174.7)[0] == 2  # too far away
    assert live.place(3, 120.0, v, None, None) == (2, 1.0)  # of equals the one seen last
    assert live.place(4, 180.0, w, -41.3, 174.7)[0] == 4
    assert live.place(5, 240.0, v, -41.3, 174.7)[0] == 5  # only the two seen last compete, and 1 is the third
    assert live.place(6, -3600.0, w, -41.3, 174.7) == (4, 1.0)  # an older item joins a newer bubble
    assert sorted(live.forget(6 * 3600.0 + 100)) == [1] and sorted(live.bubbles) == [2, 4, 5]
    assert live.place(7, 13 * 3600.0, v, -41.3, 174.7)[0] == 7


def test_alert_stream_fires_on_the_transitions_of_the_batch(spark, tmp_path):
    items = X.items(spark, SF)
    verdicts = grade.replay(items, X.registry(spark), evidence.crosses(items).drop("cross_detail")).where("dataset_id = 'live'").cache()
    want = {(r.item_id, r.from_grade, r.to_grade, r.alert_fired) for r in grade.transitions(verdicts).collect()}
    cuts = [r[0] for r in verdicts.orderBy("at").select(F.col("at").cast("string")).collect()]
    edges = [cuts[0], cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3], "2100-01-01"]
    for k in range(3):
        verdicts.where((F.col("at") >= F.lit(edges[k])) & (F.col("at") < F.lit(edges[k + 1]))).coalesce(1).write.parquet(str(tmp_path / f"f={k}"))
    stream = spark.readStream.schema(verdicts.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    q = streams.alert_stream(stream).writeStream.format("memory").queryName("alerts").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r.item_id, r.from_grade, r.to_grade, r.alert_fired) for r in spark.table("alerts").collect()}
    assert got == want and len(want) > 100


def test_candidates_by_cell_equal_all_open_ones_that_have_begun(spark):
    items = X.items(spark, SF).where("item_id % 2 = 0")
    bubbles = fold.fold_bubbles(X.items(spark, SF), ["bubble_id", "dataset_id"]).cache()
    got = {(r.item_id, r.bubble_id) for r in store.candidates(items, bubbles, candidate_limit=None).collect()}
    every = store.candidates(items, bubbles, candidate_limit=10**6).join(bubbles.select("bubble_id", "first_seen"), "bubble_id")
    want = {(r.item_id, r.bubble_id) for r in every.where("first_seen <= occurred_at + INTERVAL 6 HOURS").collect()}
    assert got == want and len(want) > 500


def test_redeliveries_go_for_good_without_a_delay(spark, item_stream):
    items, stream = item_stream
    q = streams.once(stream, None).writeStream.format("memory").queryName("once_for_good").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once_for_good").count() == items.select("dataset_id", "source", "external_id").distinct().count()
