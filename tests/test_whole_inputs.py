"""Queries take all rows and whole texts."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from witness import fixtures as X
from witness.functions import text as T
from witness.operators import assign, fold, store
from witness.queries import QUERIES, views
from witness.queries import evidence as E

SF = "/root/testdata/sf0.001"


def test_payloads_carry_whole_texts(spark):
    texts = {r.doc_id: r.text for r in X.texts(spark, SF).collect()}
    flat = lambda t: re.sub(r"\s+", " ", t).strip()
    got = {int(r.record_id.split(":w")[1]): r.text for r in QUERIES["s7_cap_features"](spark, SF).collect()}
    assert got == {i: f"Heavy rain watch — area {i % 9} — {t}"[:2000] for i, t in texts.items()}
    posts = {int(r.record_id.split("/")[-1]): r.location_text for r in QUERIES["s9_bluesky"](spark, SF).collect()}
    want = {r.doc_id: r.p for r in X.texts(spark, SF).select("doc_id", T.place_of(F.trim("text"))["place"].alias("p")).collect()}
    assert posts == want
    atom = {int(r.record_id.split(":t")[1]): r.text for r in QUERIES["s10_atom"](spark, SF).collect()}
    plain = {i: t for i, t in texts.items() if i % 5 and not re.search(r"[<&\x00-\x08\x0b-\x0c\x0e-\x1f]", t)}
    assert set(atom) == set(texts) and len(plain) > 50
    assert all(flat(atom[i]) == flat(f"Report {i} — {flat(t)}"[:2000]) for i, t in plain.items())
    rows = views._harvested(spark, SF).select("title", "text").collect()
    found = {int(r.title.split()[1]): r.text for r in rows}
    assert all(len(found[i]) >= len(flat(t)) - 1 for i, t in plain.items())
    redacted = {r.doc_id: r.text for r in QUERIES["t11_redact"](spark, SF).collect()}
    assert all(redacted[i].endswith(flat(t)[-30:]) for i, t in plain.items())


def test_origins_of_all_documents_equal_brute_force(spark):
    rows = {r.item_id: r for r in E._all_texts(spark, SF).collect()}
    words = {i: set(re.findall(r"[^\W_]+", (r.text or "").lower())) for i, r in rows.items()}
    url = lambda u: re.sub(r"^https?://(www\.)?", "", u.lower()).rstrip("/")
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in rows.items():
        for b, y in rows.items():
            if a < b and x.bubble_id == y.bubble_id:
                alike = words[a] and len(words[a] & words[b]) >= 0.85 * len(words[a] | words[b])
                quoted = url(x.url) in map(url, y.quoted_urls) or url(y.url) in map(url, x.quoted_urls)
                if alike or quoted or (x.source, x.author) == (y.source, y.author):
                    root[find(a)] = find(b)
    sets = {}
    for i in rows:
        sets.setdefault(find(i), []).append(i)
    want = {i: min(s, key=lambda k: (rows[k].occurred_at, k)) for s in sets.values() for i in s}
    assert {r.item_id: r.origin_id for r in QUERIES["o7_chained_origins"](spark, SF).collect()} == want
    sizes = {min(s, key=lambda k: (rows[k].occurred_at, k)): len(s) for s in sets.values() if len(s) > 1}
    assert {r.origin_id: r["items"] for r in QUERIES["o9_origin_groups"](spark, SF).collect()} == sizes
    assert spark.read.parquet(f"{SF}/documents.parquet").count() == len(want)


def test_every_item_gets_a_decision(spark):
    items = X.items(spark, SF)
    assert QUERIES["g2_decision_sentence"](spark, SF).where("why IS NOT NULL").count() == items.count()


def test_latest_candidates_equal_a_rank_for_each_item(spark):
    items = X.items(spark, SF).cache()
    bubbles = fold.fold_bubbles(items, ["bubble_id", "dataset_id"]).select("bubble_id", F.col("dataset_id").alias("_d"), "last_seen").cache()
    on = (F.col("dataset_id") == F.col("_d")) & (F.col("last_seen") >= F.col("occurred_at") - F.expr("INTERVAL 6 HOURS"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("last_seen"), F.desc("bubble_id")))
    want = items.drop("bubble_id").join(bubbles, on).withColumn("k", rank).where("k <= 50").select("item_id", "bubble_id")
    got = store.candidates(items, fold.fold_bubbles(items, ["bubble_id", "dataset_id"]), metres=1e9).select("item_id", "bubble_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_break_at_longer_gaps_only(spark):
    hours = [0, 5, 11, 17.001, 17.5, 23.5, 40]  # six hours are no break, a little more is one
    rows = [(d, k, float(h)) for d in ("a", "b") for k, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "dataset_id string, item_id long, h double").withColumn("occurred_at", F.timestamp_millis((F.col("h") * 3_600_000).cast("long")))
    got = assign.sessions(df, 6).collect()
    assert all([r.session for r in sorted(got, key=lambda r: r.item_id) if r.dataset_id == d] == [0, 0, 0, 1, 1, 1, 2] for d in "ab")
    # Grouping within sessions is grouping of the whole: a task gets one session, and no result crosses one.
    items = df.withColumns({"lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double"), "v": F.array(F.lit(1.0)), "item_id": F.col("item_id") + F.when(F.col("dataset_id") == "b", 100).otherwise(0)})
    groups = {r.item_id: r.group_id for r in assign.group_in_order(items).collect()}
    assert groups == {d + k: d + (0, 0, 0, 3, 3, 3, 6)[k] for d in (0, 100) for k in range(7)}


def test_rows_are_dealt_to_more_tasks_as_a_table_grows(spark):
    cores = spark.sparkContext.defaultParallelism
    for rows in (10, 1000 * cores, 5000 * cores):
        got = X.dealt(spark.range(0, rows, 1, 1), 1000)
        sizes = got.rdd.glom().map(len).collect()
        assert len(sizes) == max(cores, rows // 1000)
        assert sum(sizes) == rows and max(sizes) <= 1100
