"""Licence scans: the automaton against all runs of words, phrases against plain search, spans of whole and broken notices."""

import re

import numpy as np
import pytest

from witness.llm import license_scan as scan

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def phrase_places(text):
    """(first word, label) of every place of a phrase."""
    w = words(text)
    return [(i, label) for phrase, label in scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]


def test_matching_statistics_equal_all_runs():
    rng = np.random.default_rng(5)
    for letters, n_templates in ((2, 3), (3, 5), (6, 4)):
        draw = lambda n: [f"w{x}" for x in rng.integers(0, letters, n)]  # noqa: E731, B023
        own = [draw(rng.integers(1, 30)) for _ in range(n_templates)]
        auto = scan.Automaton.over([" ".join(t) for t in own], ["w0 w1", "w1"])
        text = draw(200)
        state = n = 0
        for at, w in enumerate(text):
            k = auto.vocabulary.get(w.encode())
            if k is None:
                state = n = 0
                continue
            while state and k not in auto.step[state]:
                state = auto.link[state]
                n = auto.longest[state]
            state, n = (auto.step[state][k], n + 1) if k in auto.step[state] else (0, 0)
            ends = lambda m: {(t, i) for t, x in enumerate(own) for i in range(m - 1, len(x)) if x[i - m + 1 : i + 1] == text[at - m + 1 : at + 1]}  # noqa: E731, B023
            longest = max(m for m in range(at + 2) if not m or ends(m))
            assert n == max(longest, 2 if at and text[at - 1 : at + 1] == ["w0", "w1"] else 0, 1 if w == "w1" else 0)
            if longest == n >= scan.MIN_MATCH:
                assert set(auto.ends[state]) == ends(n)
            here = {p for p, size in auto.phrases[state] if n >= size}
            assert here == ({0} if at and text[at - 1 : at + 1] == ["w0", "w1"] else set()) | ({1} if w == "w1" else set())


def test_phrases_over_documents_equal_plain_search(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in scan.scan_licenses(df).collect()}
    lines = {"mit": "Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
             "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    hits = 0
    for r in df.collect():
        g, places = got[r.doc_id], phrase_places(r.text)
        assert (g.n_words, g.n_base) == (len(words(r.text)), len(places))
        assert (g.first_word, g.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert g.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(g.base_labels.split(",")) <= set(g.labels.split(",")) | {""}
        for label, line in lines.items():
            if line in (r.text or ""):
                hits += 1
                assert label in g.labels.split(",") and g.score == 1.0
        if not places and not any(line in (r.text or "") for line in lines.values()):
            assert g.labels == ""
    assert hits > 10 and len(got) == 1000


@pytest.fixture(scope="module")
def auto():
    return scan.Automaton.over([t for _, t in scan.TEMPLATES], [p for p, _ in scan.PHRASES])


def spans(text, auto):
    f = scan.scan(text.encode(), auto)
    return [(scan.TEMPLATES[k][0], a, b, round(c / auto.sizes[k], 3)) for k, a, b, c in f.spans if c >= scan.MIN_COVERAGE * auto.sizes[k]]


def test_spans_of_whole_and_edited_notices(auto):
    mit = scan.TEMPLATES[2][1]
    n = len(words(mit))
    assert ("mit", 2, n + 1, 1.0) in spans("Some code. " + mit, auto)
    # A name in place of some words, a dropped and an added word: still one chain.
    edited = mit.replace("the Software without restriction", "the Product without any restriction").replace("free of charge, ", "")
    found = [s for s in spans("Some code. " + edited, auto) if s[0] == "mit"]
    assert len(found) == 1 and found[0][1] == 2 and 0.9 < found[0][3] < 1
    # Half of a notice isn't the notice; its two halves far apart aren't either.
    half = " ".join(words(mit)[: n // 2])
    assert not spans(half, auto) and not spans(half + " filler" * 40 + " " + " ".join(words(mit)[n // 2 :]), auto)
    # Twice the notice is two spans.
    assert sum(s[0] == "mit" for s in spans(mit + " filler" * 20 + " " + mit, auto)) == 2


def test_parts_out_of_order_are_no_notice(auto):
    w = words(scan.TEMPLATES[4][1])
    cut = [w[k : k + 8] for k in range(0, len(w), 8)]
    assert not spans(" ".join(x for part in reversed(cut) for x in part), auto)


def test_odd_rows(spark, auto, monkeypatch):
    long = "lorem ipsum " * 200_000 + "All  rights\nRESERVED. " + "dolor " * 10
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, "CC-BY cc by CC_BY"), (5, "CC-BY cc by CC_BY"), (None, "GENERAL PUBLIC LICENSE"), (7, "İ cc by ×")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, labels string, n_words long").repartition(3)
    got = sorted((tuple(r)[:-1] for r in scan.scan_licenses(df).collect()), key=str)
    want = []
    for i, t in rows:
        p = sorted(phrase_places(t))
        base = ",".join(sorted({x for _, x in p}))
        want.append((i, len(words(t)), len(p), p[0][0] if p else None, p[-1][0] if p else None, base, base, 1.0 if p else 0.0))
    assert got == sorted(want, key=str)
    assert scan.scan_licenses(df.where("false")).collect() == []
    whole = scan.scan(long.encode(), auto)
    monkeypatch.setattr(scan, "_PIECE", 7)
    assert scan.scan(long[-300:].encode(), auto).places == whole.places
    assert [w for part in scan.words_of("ab  cdefghijklmnop qü".encode()) for w in part] == ["ab".encode(), b"cdefghijklmnop", "qü".encode()]
