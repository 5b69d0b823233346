"""Centroid clustering in exact integers: nearest centroids by a vantage-point tree that is rebuilt and broadcast each round."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Centroids of a leaf of the tree.
LEAF = 2
#: Lower bounds held at a time: a bound for each vector and tree node.
_CELLS = 1 << 21
#: Relative and absolute slack of the float bounds, far above their rounding and far below a unit of distance.
_SLACK = 1e-9


@dataclass
class Tree:
    """Vantage-point tree over centroids; nodes by number, the root is 0.

    An inner node has a vantage centroid, and for each of its two children the least and greatest distance of the
    child's centroids from it.  A leaf has its centroids.
    """

    centres: np.ndarray
    vantage: list[int] = field(default_factory=list)
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)
    members: list[list[int]] = field(default_factory=list)

    @classmethod
    def over(cls, centres: np.ndarray) -> Tree:
        tree = cls(centres)
        tree._grow(np.arange(len(centres)))
        return tree

    def _grow(self, own: np.ndarray) -> int:
        at = len(self.vantage)
        self.vantage.append(-1)
        self.children.append([])
        self.members.append([])
        if len(own) <= LEAF:
            self.members[at] = own.tolist()
            return at
        # The centroid farthest from the others' middle tells them apart best.
        place = self.centres[own].astype(float)
        top = int(own[((place - place.mean(0)) ** 2).sum(1).argmax()])
        rest = own[own != top]
        apart = np.sqrt(squared(self.centres[rest], self.centres[top]).astype(float))
        order = np.argsort(apart, kind="stable")
        self.vantage[at] = top
        half = (len(rest) + 1) // 2
        for part in (order[:half], order[half:]):
            if len(part):
                self.children[at].append((self._grow(rest[part]), float(apart[part].min()), float(apart[part].max())))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row and its squared distance; of equally near ones the smallest number.

        Every row searches best first: it visits, of the nodes it has met, the one with the least lower bound, until
        that exceeds the best distance.  A bound equal to it is still visited, as a tie may have a smaller number.
        Bounds are floats with slack; distances are exact integers.  Rows that visit one node are worked out together.
        """
        label, best = np.full(len(x), len(self.centres), np.int32), np.full(len(x), np.iinfo(np.int64).max)
        step = max(1, _CELLS // max(1, len(self.vantage)))
        for lo in range(0, len(x), step):
            self._search(x[lo : lo + step], label[lo : lo + step], best[lo : lo + step])
        return label, best

    def _search(self, x: np.ndarray, label: np.ndarray, best: np.ndarray) -> None:
        bound = np.full((len(x), len(self.vantage)), np.inf)
        bound[:, 0] = 0.0
        rows = np.arange(len(x))

        def meet(some: np.ndarray, c: int) -> np.ndarray:
            d = squared(x[some], self.centres[c])
            closer = (d < best[some]) | ((d == best[some]) & (c < label[some]))
            best[some[closer]], label[some[closer]] = d[closer], c
            return np.sqrt(d.astype(float))

        while len(rows):
            node = bound[rows].argmin(1)
            low = bound[rows, node]
            radius = np.sqrt(best[rows].astype(float))
            go = low <= radius * (1 + _SLACK) + _SLACK
            rows, node, low = rows[go], node[go], low[go]
            for k in np.unique(node):
                here = node == k
                some, floor = rows[here], low[here]
                bound[some, k] = np.inf
                for c in self.members[k]:
                    meet(some, c)
                if self.children[k]:
                    d = meet(some, self.vantage[k])
                    for child, least, most in self.children[k]:
                        bound[some, child] = np.maximum(floor, np.maximum(d - most, least - d) - _SLACK * (1 + d))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


def integers(vectors: pa.Array, dims: int = DIMS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their components as floor(scale * x).

    Kept are rows of exactly ``dims`` components, none null or not finite.
    """
    kept = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False))
    x = vectors.filter(pa.array(kept)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    fine = np.isfinite(x).all(1)
    kept[np.flatnonzero(kept)[~fine]] = False
    x = np.floor(x[fine] * scale)
    # Beyond this, squared distances of two vectors may exceed a long.
    most = int((2**63 - 1) // dims) ** 0.5 / 2
    if x.size and np.abs(x).max() >= most:
        raise ValueError(f"a component beyond {most / scale:.0f} leaves no exact distance")
    return kept, x.astype(np.int64)


def _seeds(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The k kept vectors with the smallest hash of ``seed:id``, as integers; of equal hashes by components."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integers(batch["v"], dims, scale)
            ends = pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch["h"].filter(pa.array(kept)), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["h", "v"])

    named = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "v")
    first = named.mapInArrow(keep, "h string, v array<long>").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in first], np.int64).reshape(-1, dims)


def _round(vectors: DataFrame, tree: Broadcast, k: int, dims: int, scale: int) -> np.ndarray:
    """For each centroid the sums of its vectors' components, their number and the sum of their distances (Python integers).

    Tasks add up their own vectors, so that few rows are shuffled whatever a cluster's size.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 2), object)
        for batch in batches:
            _, x = integers(batch["v"], dims, scale)
            label, d = tree.value.nearest(x)
            for c in np.unique(label):
                own = label == c
                total[c, :dims] += x[own].sum(0).astype(object)
                total[c, dims] += int(own.sum())
                total[c, dims + 1] += sum(d[own].tolist())
        c, pos = np.nonzero(total)
        told = pa.array([Decimal(int(total[i, j])) for i, j in zip(c, pos, strict=True)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(pos.astype(np.int32)), told], ["c", "pos", "s"])

    sums = vectors.select("v").mapInArrow(add, "c int, pos int, s decimal(38,0)").groupBy("c", "pos").agg(F.sum("s").alias("s"))
    out = np.zeros((k, dims + 2), object)
    for r in sums.collect():  # k * (dims + 2) rows at most
        out[r.c, r.pos] = int(r.s)
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept row of ``vectors`` (vec_id, embedding).

    Components become floor(scale * x).  Centroids start as the kept vectors with the smallest hashes; each round
    assigns all vectors and moves every centroid that has some to the floor of their mean; then all are assigned once
    more.  All of it is integer arithmetic, so results don't depend on the order or partitioning of rows.

    Rows with a null vector, another length, a null or a non-finite component are left out.  A null id hashes as an
    empty one.  Repeated rows count each; equal seeds leave the later ones empty.  With fewer kept vectors than ``k``
    there are as many centroids; an empty table gives none.  Components of 2^27 or more after scaling are an error, as
    their distances need not fit a long.  The driver holds k * dims integers.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    centres = _seeds(own, k, dims, scale, seed)
    k = len(centres)
    inertia = [0] * k
    for turn in range(rounds + 1 if k else 0):
        tree = spark.sparkContext.broadcast(Tree.over(centres))
        total = _round(own, tree, k, dims, scale)
        tree.unpersist()
        inertia = total[:, dims + 1].tolist()
        if turn < rounds:
            filled = total[:, dims] > 0
            centres = centres.copy()
            centres[filled] = (total[filled, :dims] // total[filled, dims : dims + 1]).astype(np.int64)
    last = spark.sparkContext.broadcast(Tree.over(centres))
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integers(batch["v"], dims, scale)
            label, d = last.value.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].filter(pa.array(kept)), pa.array(label), pa.array(d), pa.array([inertia[c] for c in label], pa.int64()),
                 pa.array([sum(inertia)] * len(label), pa.int64()), pa.array([names[c] for c in label], pa.string())],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return own.mapInArrow(assign, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
