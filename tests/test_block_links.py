"""Restatements by blocks of sets against plain loops."""

import random

from pyspark.sql import functions as F

from witness.operators import origins, setjoin
from witness.operators.graph import components


def classes(ids, links):
    root = {i: i for i in ids}
    for a, b in links:
        x, y = root[a], root[b]
        if x != y:
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root


def test_blocks_give_the_components_of_all_pairs(spark):
    """Kinds that are close to others but not to all of their block; blocks smaller than a bubble; equal sets."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    alike = {0: [0, 1], 1: [0, 1, 2], 2: [1, 2], 3: [3], 4: []}
    rows = []
    for i in range(240):
        t = rng.sample(words[: 30 if i % 2 else 60], rng.randint(1, 25))
        rows.append((f"b{i % 3}" if i % 17 else None, i, t if i % 9 else words[:5], i % 5, alike[i % 5]))
    sets = spark.createDataFrame(rows, "bubble_id string, item_id long, t array<string>, kind long, alike array<long>").where("bubble_id IS NOT NULL")
    rows = [r for r in rows if r[0] is not None]
    want = [(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[0] == y[0] and y[3] in x[4] and len({*x[2]} & {*y[2]}) >= 0.5 * len({*x[2]} | {*y[2]})]
    for block in (16, 1000):
        found = setjoin.block_links(sets, 0.5, block).collect()
        assert {(r.a, r.b) for r in found} <= set(want) and len(found) < len(want)
        assert classes([r[1] for r in rows], [(r.a, r.b) for r in found]) == classes([r[1] for r in rows], want)


def test_restatements_with_few_and_many_vectors(spark, monkeypatch):
    """The same links' components whether different vectors are few or not; a vector without length links nothing."""
    rng = random.Random(7)
    vs = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.0, 0.0]]
    rows = [("d" if i % 11 else None, i, " ".join(rng.sample("a b c d e f g h".split(), rng.randint(0, 6))), vs[i % 4]) for i in range(80)]
    items = spark.createDataFrame(rows, "bubble_id string, item_id long, text string, embedding array<double>")
    few = {tuple(r) for r in components(origins.restatement_links(items).select("a", "b")).collect()}
    pairs = origins.restatement_links(items).where(F.col("a") % 4 == 3).count()
    monkeypatch.setattr(origins, "MAX_KINDS", 1)
    many = {tuple(r) for r in components(origins.restatement_links(items).select("a", "b")).collect()}
    assert few == many and len(few) > 10 and pairs == 0


def test_sets_go_only_to_blocks_of_near_sizes(spark):
    """200 sets of 5 words and 200 of 60, in blocks of some four and two: none of the first meets one of the others."""
    rows = [("b", k, [f"w{k}_{x}" for x in range(5 if k % 2 else 60)], 0, [0]) for k in range(400)]
    sets = spark.createDataFrame(rows, "bubble_id string, item_id long, t array<string>, kind long, alike array<long>")
    dealt = setjoin._dealt(sets, 0.5, 1).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r.i, r.j), []).append(r)
    together = {(min(x.item_id, y.item_id), max(x.item_id, y.item_id)) for found in tasks.values() for x in found for y in found if x.item_id < y.item_id and (x.own != y.own or x.i == x.j)}
    assert {(a, b) for a in range(400) for b in range(a + 1, 400) if (a - b) % 2 == 0} <= together
    mixed = sum((a - b) % 2 for a, b in together)
    assert mixed <= 1600  # of 40,000: only of the block in which sizes change
    assert max(sum(len(r.ws) + 64 for r in found) for found in tasks.values()) <= 2 * 5 * 256
