"""Sets that meet by equal parts: all similar pairs, few others; quotes as chains."""

import numpy as np

from witness.operators import origins, setjoin


def _sets(rng, n):
    """Edited copies of texts of all sizes whose words are frequent like those of a language."""
    words = np.minimum(rng.zipf(1.2, 40_000), 900)
    rows = []
    for k in range(n):
        size = int(rng.integers(1, 14) if k % 3 == 0 else rng.integers(14, 260))
        base = {f"w{x}" for x in words[rng.integers(0, len(words), size)]}
        rows.append(base)
        for _ in range(k % 3):
            edited = {x for x in base if rng.random() > 0.06} | {f"new{rng.integers(0, 50)}" for _ in range(len(base) // 30)}
            if edited:
                rows.append(edited)
    return list({tuple(sorted(x)): None for x in rows})


def _alike(sets, least=0.85):
    each = list(map(set, sets))
    return {(i, j) for i in range(len(each)) for j in range(i + 1, len(each)) if len(each[i] & each[j]) / len(each[i] | each[j]) >= least}


def test_all_similar_pairs_meet(spark):
    sets = _sets(np.random.default_rng(3), 240)
    want = _alike(sets)
    df = spark.createDataFrame([("b", i, list(t)) for i, t in enumerate(sets)] + [(None, 9_000 + i, list(t)) for i, t in enumerate(sets[:9])], "bubble_id string, item_id long, t array<string>")
    assert len(want) > 80 and {(r.a, r.b) for r in setjoin.all_pairs(df, 0.85).collect()} == want
    found = {(r.a, r.b) for r in setjoin.links(df, 0.85).collect()}
    root = {i: i for i in range(len(sets))}

    def find(pairs):
        at = dict(root)
        for _ in range(len(sets)):
            new = dict(at)
            for a, b in pairs:
                new[a] = new[b] = min(new[a], new[b])
            if new == at:
                return at
            at = new

    assert found <= want and find(found) == find(want)


def test_common_words_make_few_candidates(spark, monkeypatch):
    """Every two sets share some of a small vocabulary, even among their rarest words; hardly any are similar."""
    rng, seen, real = np.random.default_rng(5), [], setjoin._alike
    monkeypatch.setattr(setjoin, "_alike", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    rows = [("b", i, [f"w{x}" for x in rng.choice(300, 90, replace=False)]) for i in range(400)]
    assert setjoin.links(spark.createDataFrame(rows, "bubble_id string, item_id long, t array<string>"), 0.85).count() == 0
    assert sum(seen) < 400


def test_quotes_of_one_address_are_a_chain(spark):
    n = 60
    rows = [("b", i, "http://x.org/a", ["https://www.x.org/A/"] if i % 2 else []) for i in range(n)] + [("b", 100, "http://x.org/own", ["http://x.org/own"]), ("b", 101, "http://y.org", None), ("c", 102, None, ["http://y.org"])]
    items = spark.createDataFrame([(*r, "s", None, "", None) for r in rows], "bubble_id string, item_id long, url string, quoted_urls array<string>, source string, author string, text string, occurred_at timestamp")
    found = [(r.a, r.b, r.why) for r in origins.links(items).collect()]
    assert len(found) == n - 1 and {a for a, _, _ in found} == {0} and {b for _, b, _ in found} == set(range(1, n))
    assert {w for _, _, w in found} == {"quotes x.org/a — a repost is not a second witness"}
