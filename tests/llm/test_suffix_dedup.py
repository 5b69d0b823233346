"""Suffix-array dedup against a plain search for repeated strings."""

import hashlib
import random
from collections import Counter

import pytest

from witness.llm import suffix_dedup as S


def brute(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    shared, hot = text(300), text(90)
    out = [text(r.randrange(0, 500)) for _ in range(25)]
    for _ in range(12):
        a, n = r.randrange(200), r.randrange(20, 100)
        out.append(text(r.randrange(90)) + shared[a : a + n] + text(r.randrange(90)))
    out += [text(r.randrange(60)) + hot + text(r.randrange(60)) for _ in range(30)]
    out += [out[3], out[3], "x" * 200, "x" * 60 + text(30), None, "", "short", "ab" * 120]
    near = list(out[40] * 3)
    near[50] = "Q"
    out.append("".join(near))
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 10_000), (2, 4)])
def test_removed_bytes_equal_brute_force(spark, seed, most):
    texts = made(seed)
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes long, _id2 string").repartition(3)
    got = {r.doc_id: r[1:] for r in S.remove_repeats(df, 40, max_contexts=most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    want = brute(texts, 40)
    for i, w in enumerate(want):
        assert tuple(got[i]) == w, (i, texts[i])
    assert any(0 < w[1] < w[0] for w in want)


def test_repeated_rows_and_null_ids_are_documents_of_their_own(spark):
    t = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(200))
    df = spark.createDataFrame([(1, t), (1, t), (None, "z" + t[:100]), (2, "q" * 30)], "doc_id long, text string")
    got = sorted(tuple(r) for r in S.remove_repeats(df, 50).select("n_bytes", "n_removed").collect())
    assert got == [(30, 0), (101, 100), (200, 200), (200, 200)]


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0


def test_intervals_of_banana():
    # suffixes a, ana, anana, banana, na, nana
    assert sorted(S.prefix_intervals([0, 1, 3, 0, 0, 2], 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_group_repeats_are_maximal_and_list_all_occurrences():
    core = bytes(range(65, 95))
    contexts = [b"1" + core + b"x", b"2" + core + b"y", b"33" + core + b"z"]
    import numpy as np

    got = S.group_repeats(contexts, np.array([1, 1, 2]), np.array([3, 3, 4]), 29)
    assert sorted((i, s, n) for _, i, s, n in got) == [(0, 1, 30), (1, 1, 30), (2, 2, 30)]
    assert len({k for k, *_ in got}) == 1


def test_maximal_repeats_list_every_occurrence_and_extend_no_further_in_their_context(spark):
    texts = [t or "" for t in made(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = S.maximal_repeats(df, 40).join(df.select(S.row_key(df)[0], S.row_key(df)[1], "doc_id"), ["_id", "_th"]).collect()
    data = [t.encode() for t in texts]
    groups = {}
    for r in rows:
        groups.setdefault((r.anchor, r.repeat), set()).add((r.doc_id, r.start, r.length))
    assert groups
    covered = [bytearray(len(d)) for d in data]
    for found in groups.values():
        said = {data[i][a : a + n] for i, a, n in found}
        assert len(said) == 1 and len(found) > 1
        (word,) = said
        everywhere = {(i, a) for i, d in enumerate(data) for a in range(len(d) - len(word) + 1) if d[a : a + len(word)] == word}
        assert {(i, a) for i, a, _ in found} == everywhere
        for i, a, n in found:
            covered[i][a : a + n] = b"\1" * n
    assert [sum(c) for c in covered] == [w[1] for w in brute(texts, 40)]


def test_very_long_text_and_clashing_columns(spark):
    r = random.Random(9)
    unit = "".join(r.choice("abcdefgh ") for _ in range(700))
    long = "".join(r.choice("abcdefgh ") for _ in range(400_000)) + unit
    df = spark.createDataFrame([(1, long, "x", 5), (2, "q" + unit, "y", 6), (2, "q" + unit, "y", 6)], "doc_id long, text string, _row string, _spans int")
    got = sorted(tuple(x) for x in S.remove_repeats(df).select("doc_id", "n_removed", "_row", "_spans").collect())
    assert got == [(1, 700, "x", 5), (2, 701, "y", 6), (2, 701, "y", 6)]
    assert S.rewrite(df).columns == df.columns
