"""Centroid clustering against plain code, and its tree against all distances."""

from hashlib import sha256
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from witness.llm import centroids

SF = "/root/testdata/sf0.001"


def plain(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) of each kept row."""
    kept = [(i, [floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    first = sorted((sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    per = [sum(d for d, c in found if c == n) for n in range(len(centres))]
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, per[c], sum(per), names[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in centroids.cluster(df, **kw).collect()), key=str)


def test_whole_table_equals_plain_code(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(df.repartition(5)) == plain(rows)


def test_odd_rows_ties_and_repeats(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [-0.0001, 3.0]), (None, [2.0, 2.0]), (10, [1.0, 2.0, 3.0]), (11, [-5.0, 0.1]), (12, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    for k in (1, 3, 8):
        assert got(df, dims=2, k=k) == plain(rows, dims=2, k=k)
    assert got(df.where("false"), dims=2) == []
    assert got(df.where("vec_id = 3"), dims=2) == []


def test_huge_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves no exact distance"):
        centroids.cluster(df, dims=2).collect()


def test_tree_equals_all_distances():
    """Many ties: small integers, repeated centroids, points on centroids."""
    rng = np.random.default_rng(1)
    for n, k, d, most in ((500, 8, 3, 3), (500, 40, 2, 5), (300, 100, 4, 2), (200, 1, 3, 9), (200, 60, 8, 10_000)):
        x, c = rng.integers(-most, most + 1, (n, d)), rng.integers(-most, most + 1, (k, d))
        label, best = centroids.Tree.over(c).nearest(x)
        every = ((x[:, None] - c) ** 2).sum(2)
        assert (best == every.min(1)).all() and (label == every.argmin(1)).all()


def test_pruning_leaves_centroids_unmet(monkeypatch):
    """Far apart groups: a search meets few of the centroids."""
    rng = np.random.default_rng(2)
    c = rng.integers(-50, 50, (64, 4)) + np.arange(64)[:, None] * 100_000
    met, plain_squared = [0], centroids.squared
    tree = centroids.Tree.over(c)

    def counted(x, y):
        met[0] += len(x)
        return plain_squared(x, y)

    monkeypatch.setattr(centroids, "squared", counted)
    x = c[rng.integers(0, 64, 1000)] + rng.integers(-9, 9, (1000, 4))
    tree.nearest(x)
    assert met[0] < 1000 * 20


def test_order_of_rows_does_not_matter(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 60")
    assert got(df.repartition(4), rounds=3) == got(df.orderBy(F.desc("vec_id")).coalesce(1), rounds=3)
