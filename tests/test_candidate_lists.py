"""Decisions from the candidates in an item's own row."""

from pyspark.sql import functions as F

from witness import fixtures as X
from witness.operators import assign, fold, store
from witness.queries import evidence

SF = "/root/testdata/sf0.001"


def test_lists_decide_as_pairs_do(spark):
    items = X.items(spark, SF).withColumn("lat", F.when(F.col("item_id") % 9 > 0, F.col("lat")))
    bubbles = fold.fold_bubbles(items.where("dataset_id = 'live'"), ["bubble_id", "dataset_id"])
    alike = lambda i, b: F.pmod(F.xxhash64(i, b), F.lit(7)) / 7.0
    pairs = store.candidates(items, bubbles, keep_far=True).withColumn("similarity", alike(F.col("item_id"), F.col("bubble_id")))
    want = {r.item_id: r for r in assign.decide(pairs).collect()}
    got = {r.item_id: r for r in assign.decide_in_lists(store.candidate_lists(items, bubbles), lambda x: alike(F.col("item_id"), x["bubble_id"])).collect()}
    assert len(got) == items.count() and {k: r for k, r in got.items() if k in want} == want
    assert all(r.bubble_id is None and not r.joined and r.blocked is None for k, r in got.items() if k not in want) and len(want) < len(got)


def test_decisions_sort_and_shuffle_no_pairs(spark):
    for f in (evidence.g1_decide, evidence.g2_decision_sentence):
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "array_max" in plan and "max_by(struct(bubble_id" not in plan
