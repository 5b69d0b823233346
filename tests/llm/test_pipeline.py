"""The pipeline's stages against plain code over what their predecessor kept."""

import re
from collections import Counter

import corpus_pipeline as P
import pytest

from tests.llm.plain import benchmark_leaks, removed
from tests.llm.test_similar import brute as similar_groups
from witness.llm import quality_ranker

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found.append(docs.toPandas())
    return [spark.read.parquet(f"{SF}/documents.parquet").toPandas(), *found]


def test_columns_are_kept(outputs):
    assert all(list(o.columns) == list(outputs[0].columns) for o in outputs[:5])


def test_classifier_stage(spark, outputs):
    ranked = quality_ranker.rank(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert set(outputs[1].doc_id) == set(ranked.doc_id[ranked.predicted == 1])
    assert 0 < len(outputs[1]) < len(outputs[0])


def test_near_dedup_stage(outputs):
    want = similar_groups(dict(zip(outputs[1].doc_id, outputs[1].text, strict=True)))
    assert set(outputs[2].doc_id) == set(want.values())
    assert len(outputs[2]) < len(outputs[1])


def test_passage_stage(outputs):
    want = removed(list(outputs[2].text), P.MIN_PASSAGE_BYTES)
    assert outputs[3].sort_values("doc_id").text.tolist() == [
        k.decode("utf-8", "ignore") for _, k in sorted(zip(outputs[2].doc_id, want, strict=True))
    ]
    assert (outputs[3].n_chars == outputs[3].text.str.len()).all()


def test_decontamination_stage(spark, outputs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    leak = benchmark_leaks(dict(zip(outputs[3].doc_id, outputs[3].text, strict=True)), dict(zip(items.item_id, items.text, strict=True)))
    assert set(outputs[4].doc_id) == set(outputs[3].doc_id) - {d for d, _ in leak}


def test_mixing_stage(outputs):
    size = Counter()
    for s, t in zip(outputs[4].source, outputs[4].text, strict=True):
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    target, budget = dict.fromkeys(size, 0.0), 1.5 * sum(size.values())
    free = set(size)
    while True:
        for s in free:
            target[s] = budget * weight[s] / sum(weight[x] for x in free)
        full = {s for s in free if target[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            budget -= target[s]
        free -= full
    got = outputs[5].groupby("source").taken.sum()
    for s in size:
        assert got.get(s, 0) == int(target[s] + 1e-6)
    assert (outputs[5].taken <= 2 * outputs[5]["size"]).all()


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id long, fp long, size string, taken long, kept_text string, item_id long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, repeated rows, one very long text and columns named like the stages' own."""
    tail = ("r", 1, 2, "s", -1, "k", 3)
    prose = " ".join(f"word{i} of the day" for i in range(60))
    rows = [
        (1, None, None, None, None, *tail), (2, "", "en", "a", 0, *tail), (3, " \n", "en", "", 2, *tail),
        (4, "lorem ipsum dolor " * 60_000, "en", "b", 1, *tail), (5, prose, "en", "b", 1, *tail), (5, prose, "en", "b", 1, *tail),
        (6, prose + " and more", "en", "b", 1, *tail), (None, prose, "de", "a", 1, *tail), (None, None, None, None, None, *tail), (8, "short", "fr", "a", 5, *tail),
    ]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_rows_and_none(spark, odd, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, SF)
    got = sorted((r.doc_id or 0 for r in out.collect()))
    if name == "mixing":
        assert out.columns == [c for c in odd.columns if c not in ("size", "taken")] + ["size", "source_size", "target", "taken"]
        assert all(r.taken > 0 and r._row == "r" for r in out.collect()) and set(got) <= {0, 4, 5, 6, 8}
    else:
        assert out.columns == odd.columns and all(r.taken == -1 and r.kept_text == "k" for r in out.collect())
    if name == "simhash near-dedup":  # of repeated rows one; rows without an id or without words stay
        assert got == [0, 0, 1, 2, 3, 4, 5, 8]
    if name == "suffix-array dedup":
        assert got == sorted(r.doc_id or 0 for r in odd.collect())
        text = {r.doc_id: r.text for r in out.collect()}
        assert text[1] is None and text[5] == "" and text[6].strip() == "and more" and text[8] == "short" and len(text[4]) < 300
    if name == "benchmark decontamination":
        assert got == sorted(r.doc_id or 0 for r in odd.collect())
    assert stage(spark, odd.where("false"), SF).count() == 0


def test_run_leaves_only_its_result_behind(spark, outputs):
    import pathlib

    folder = pathlib.Path(P.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = P.run(spark, SF)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(outputs[5].doc_id)
    assert len(set(folder.iterdir()) - before) == 1


def test_one_row_of_an_id_whatever_the_order_of_rows(spark):
    rows = [(1, "some text of five words here", "a"), (1, "another text that is not alike at all", "b"), (1, "another text that is not alike at all", "c"), (2, "x y z", "d")]
    found = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(4)
        kept = P.near_dedup(spark, docs, SF).collect()
        assert sorted(r.doc_id for r in kept) == [1, 2]
        found.add(frozenset(map(tuple, kept)))
    assert len(found) == 1
