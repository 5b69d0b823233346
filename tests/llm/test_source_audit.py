"""The source audit against its SQL and plain code, and pointer sorting against sorted words."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from witness.llm import source_audit

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_docs=30, top=50):
    groups, df, n = set(), Counter(), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lowered(text or ""))
        df.update((lang, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), k in df.items() if x == lang and k >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        count = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in count.items()}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in source_audit.audit(df, **kw).collect())


def test_equals_sql_over_documents(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(source_audit.ORACLE.replace("{docs}", "documents")).fetchall())
    assert got(spark.read.parquet(f"{SF}/documents.parquet")) == want


@pytest.fixture(scope="module")
def odd():
    rows = [(None, None, None), ("", "en", "a"), ("Word word WORD", "en", "a"), ("word other", "en", "b"), ("word other", "en", "b"), ("12 --- 7", "en", "c"), ("über Über ÜBER", "de", None),
            ("über x y Straße", "de", "z"), ("solo", "fr", "only"), ("a" * 50 + " " + "a" * 49 + " word", "en", "d"), ("eightlet eightlets eightlet", "en", "d"), ("日本 語 日本", "", "")]
    return rows * 3 + [("İstanbul word", "en", "b")]


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(*r, "x", 1) for r in odd], "text string, lang string, source string, term string, n long").repartition(3)
    for least in (1, 2, 4, 99):
        assert got(df, min_docs=least, top_terms=3) == plain(odd, least, 3)
    assert got(df.where("false")) == []
    assert got(df.where("text is null"), min_docs=1) == []


def test_long_documents_in_pieces(spark, odd, monkeypatch):
    """Shards of a few bytes: documents in pieces count once for each of their terms."""
    rows = [*odd, ("word tail " * 40 + "x" * 300 + " tail", "en", "long")]
    batch = __import__("pyarrow").RecordBatch.from_pydict({"text": [r[0] or "" for r in rows], "lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows]})
    monkeypatch.setattr(source_audit, "_SHARD", 64)
    n, docs = Counter(), Counter()
    for out in source_audit._counted(iter([batch.slice(0, 5), batch.slice(5)])):
        for r in out.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want_n, want_docs = Counter(), Counter()
    for text, lang, source in rows:
        terms = TERM.findall(lowered(text or ""))
        want_n.update((lang or "", source or "", t) for t in terms)
        want_docs.update((lang or "", source or "", t) for t in set(terms))
    assert +n == want_n and +docs == want_docs


def test_pointers_in_order():
    rng = np.random.default_rng(3)
    text = b" ".join(bytes(rng.integers(97, 99, rng.integers(1, 20)).astype(np.uint8)) for _ in range(5000))
    data = np.frombuffer(text, np.uint8)
    starts, lens = source_audit.pointers(data, np.zeros(len(data), bool))
    order, first = source_audit.sort_pointers(data, starts, lens)
    words = [text[starts[k] : starts[k] + lens[k]] for k in order]
    assert words == sorted(text.split())
    assert [a != b for a, b in zip(words[1:], words, strict=False)] == first[1:].tolist()
