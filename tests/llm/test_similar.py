"""Similarity groups against brute force over all pairs."""

import corpus_pipeline as P

from witness.llm import similar


def brute(texts, least=0.8, k=5):
    """Smallest id of each text's group; sets of ``k``-word shingles are linked at ``least``."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_stage_equals_brute_force_on_edits_and_chains(spark):
    base = [f"w{i}" for i in range(200)]
    texts = {k: " ".join(base[: 200 - 3 * k]) for k in range(12)}  # a chain: neighbours are close, its ends are not
    for k in range(1, 9):  # one to eight words replaced, five shingles each
        texts[20 + k] = " ".join(f"x{i}" if i % 20 == 0 and i < 20 * k else f"y{i}" for i in range(160))
    line = " ".join(f"common{i}" for i in range(30))  # a passage that many unlike texts share
    texts |= {40 + k: f"{line} " + " ".join(f"u{k}v{i}" for i in range(20)) for k in range(30)}
    texts |= {80: "one two", 81: "ONE  two", 82: "one three", 83: "", 84: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert len({want[k] for k in range(12)}) == 1
    assert len({want[k] for k in range(40, 70)}) == 30
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect() if r.fp}
    assert got == {i: c for i, c in want.items() if i not in (83, 84)}
    kept = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    assert kept == set(got.values()) | {83, 84}


def test_blocks_and_whole_groups_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some, got = ({r.doc_id: r.component_id for r in similar.near_duplicates(docs, block=b).collect() if r.fp} for b in (3, 2_000))
    assert some == got
    want = brute({r.doc_id: r.text for r in docs.collect()})
    assert got == {i: want[i] for i in got}


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (None, "A b  c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "x y z")]
    rows += [(5, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS n", "3 AS component_id", "4 AS row")
    got = sorted(((r.doc_id, r.component_id) for r in similar.near_duplicates(docs).collect()), key=str)
    want = [(1, 1), (None, 1), (2, 1), (2, 1), (3, 3), (4, 3), (None, None), (5, 5)]
    assert got == sorted(want, key=str)
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprints_give_the_near_dedup_stage_its_candidates(spark, monkeypatch):
    """Texts within four bits meet by fingerprint, and groups stay those of all pairs of the exact similarity."""
    import corpus_pipeline as P

    from witness.llm import similar, simhash

    base = [" ".join(f"w{k}x{j}" for j in range(400)) for k in range(4)]
    texts = [*base, base[0] + " z", base[1] + " z", base[1].replace("w1x200", "q"), base[2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, plain = [], similar.fingerprint_pairs
    monkeypatch.setattr(similar, "fingerprint_pairs", lambda one: seen.extend(plain(one).collect()) or plain(one))
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == [0, 1, 2, 3]
    sims = {similar._set_hash(similar.shingle_set(t)) - (1 << 64) * (similar._set_hash(similar.shingle_set(t)) >> 63): simhash.fingerprint(t) for t in texts}
    assert seen and all((sims[r.a] ^ sims[r.b]).bit_count() <= 4 for r in seen)
