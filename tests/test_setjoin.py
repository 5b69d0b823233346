"""Links between similar sets connect what all pairs connect, and are few."""

import numpy as np
from pyspark.sql import functions as F

from witness.operators import origins, setjoin
from witness.operators.graph import components


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(n)]


def test_links_have_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    for least, n, words, size in ((0.85, 150, 60, 12), (0.5, 120, 40, 8), (0.85, 100, 2000, 30)):
        sets = []
        for k in range(n):  # edits of earlier sets, chains of edits, and sets of their own
            t = set(sets[rng.integers(0, k)][1]) if k and rng.random() < 0.7 else {f"w{x}" for x in rng.integers(0, words, size)}
            for _ in range(rng.integers(0, 3)):
                t ^= {f"w{rng.integers(0, words)}"}
            sets.append((f"b{int(rng.integers(0, 2))}", t or {"w0"}))
        rows = [(b, k, sorted(t)) for k, (b, t) in enumerate(sets)]
        once = {}
        for r in rows:
            once.setdefault((r[0], tuple(r[2])), r)
        df = spark.createDataFrame(list(once.values()), "bubble_id string, item_id long, t array<string>").repartition(3)
        found = setjoin.links(df, least)
        got = {r.node: r.root for r in components(found.select("a", "b")).collect()}
        jaccard = lambda a, b: sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= least  # noqa: E731, B023
        want = classes(n, jaccard)
        first = {k: once[sets[k][0], tuple(sorted(sets[k][1]))][1] for k in range(n)}
        assert [got.get(first[k], first[k]) for k in range(n)] == want
        assert all(abs(r.overlap - len(sets[r.a][1] & sets[r.b][1]) / len(sets[r.a][1] | sets[r.b][1])) < 1e-12 for r in found.collect())


def test_near_copies_make_few_links(spark):
    """400 edits of one text: some links for each, not 79,800 pairs."""
    base = " ".join(f"word{k}" for k in range(60))
    rows = [("b", k, f"{base} own{k}") for k in range(400)] + [("b", 1000 + k, f"{base} own{k}") for k in range(50)]
    items = spark.createDataFrame(rows, "bubble_id string, item_id long, text string")
    found = origins.wording_links(items)
    assert found.count() < 3 * 450
    assert origins.wording_classes(items).agg(F.countDistinct("class_id")).first()[0] == 1


def test_no_sets(spark):
    assert setjoin.links(spark.createDataFrame([], "bubble_id string, item_id long, t array<string>"), 0.85).count() == 0
    none = spark.createDataFrame([("b", 1, None), ("b", 2, ""), ("b", 3, "...")], "bubble_id string, item_id long, text string")
    assert sorted(map(tuple, origins.wording_classes(none).collect())) == [(1, 1), (2, 2), (3, 3)]
