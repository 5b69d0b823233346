"""Connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witness.plans.lineage import cut, drop_cut


#: Different edges that one task puts together (4 MB of them); of more every round is distributed.
SMALL = 1 << 18


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of a task."""
    both = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*((x["u"].to_numpy(), x["v"].to_numpy()) for x in batches), strict=True)]
    if not both:
        return
    nodes, at = np.unique(np.concatenate(both), return_inverse=True)
    u, v = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """Connected components of an edge table of longs -> (node, root), root being the smallest id of the component.

    Alternating large-star and small-star passes: each links every neighbour of a node to the smallest id nearby, so
    chains halve and a hub needs only sums that combine before the shuffle plus a join that AQE can split.  Only nodes
    with an edge to another node are returned.  Every round is written to the shared folder; its predecessor goes.  Up to
    ``small`` different edges, whatever the input, are put together by one task: rounds would cost the driver some ten
    stages each.
    """
    u, v = F.col(a), F.col(b)
    now = cut(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        row = df.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        ).first()
        return tuple(row)

    seen = mark(now)
    if 0 < seen[0] <= small:
        out = cut(now.coalesce(1).mapInArrow(_put_together, "node long, root long"))
        drop_cut(now)
        return out
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        ).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        new = cut(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        got = mark(new)
        drop_cut(now)
        now, done, seen = new, got == seen, got
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def spanning_forest(edges: DataFrame, weight: str = "w", max_rounds: int = 60) -> DataFrame:
    """a, b, w: a minimum spanning forest of weighted edges between longs; of equal weights the smaller (a, b) goes first.

    Kept to weights up to w, the forest spans the components of all edges up to w: nodes minus forest edges is the number
    of components at any time, if weights are times.  In each round every component takes its lightest edge to another
    one, and components that are joined by those become one, so rounds are few; all is aggregated before it is shuffled.
    """
    far = F.struct(weight, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut(edges.where("a <> b").select(far.alias("e")).distinct().select(F.col("e.a").alias("u"), F.col("e.b").alias("v"), "e"))
    forest = None
    for _ in range(max_rounds):
        ends = rest.select("u", F.struct("e", "u", "v").alias("x")).unionByName(rest.select(F.col("v").alias("u"), F.struct("e", "u", "v").alias("x")))
        picked = cut(ends.groupBy("u").agg(F.min("x").alias("x")).select("x.*").distinct())
        if picked.isEmpty():
            break
        forest = picked.select("e.*") if forest is None else forest.unionByName(picked.select("e.*"))
        root = components(picked, "u", "v")
        r = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        moved = rest.join(r("u"), "u", "left").join(r("v"), "v", "left").select(F.coalesce("_u", "u").alias("x"), F.coalesce("_v", "v").alias("y"), "e").where("x <> y")
        # Between two components only the lightest edge can count.
        light = cut(moved.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("e").alias("e")))
        drop_cut(rest)
        rest = light
    else:
        raise RuntimeError(f"a spanning forest was not found in {max_rounds} rounds")
    return forest if forest is not None else rest.select("e.*")
