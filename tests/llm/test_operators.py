"""Each operator on odd rows (nulls, empty and long texts, ties, repeats, clashing columns) and against plain code."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.plain import benchmark_leaks, groups
from witness.llm import decontaminate, langid, lm_score, mixing, quality_ranker, quality_rules, simhash, token_counts, url_filter
from witness.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, u string, _id string"
LONG = "lorem ipsum dolor " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty everything, blanks only, a very long text, repeated rows, columns named like operators' own."""
    rows = [
        (1, None, None, None, None, 9, 9, "x", "y"),
        (2, "", "en", "a", 0, 9, 9, "x", "y"),
        (3, " \n\t ", "en", "a", 4, 9, 9, None, None),
        (4, LONG, "en", "b", len(LONG), 9, 9, "x", "y"),
        (5, "Plain words here, and some more of them.", "en", "b", 1, 9, 9, "x", "y"),
        (5, "Plain words here, and some more of them.", "en", "b", 1, 9, 9, "x", "y"),
        (None, "Text without an id", "de", "", 1, 9, 9, "x", "y"),
        (7, "!!! ??? 123", "fr", "a", 1, 9, 9, "x", "y"),
        (8, "über \U0001f600 straße İstanbul", "de", "b", 1, 9, 9, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# ---------------------------------------------------------------- 1


def test_urls_by_rule_alias_and_default(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "https://a.Example.NET/en/1", None),  # allowed by the longer rule
        (2, "http://b.net/x?q#f", None),  # blocked
        (3, "https://plain.com/p", link("http://b.net/x?q")),  # alias of a blocked page
        (4, "https://other.com/q", link("https://plain.com/p/")),  # alias over two steps
        (5, "https://mix.com/a", link("http://b.net/x?q") + link("https://a.example.net/en/1")),  # joins the sets
        (6, "https://free.com/", "<p>"),
        (7, None, None),
        (8, "no scheme", None),
        (9, "https://example.com/de/7", link("https://a.example.net/en/1")),  # its own rule stays
        (None, "http://b.net/x?q", None),
        (11, "http://gone.com/1", '<meta http-equiv="refresh" content="0; url=https://bad.net/z">'),  # names a blocked address only
        (12, "http://www.free.com#top", None),
    ]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: v.verdict for k, v in got.items()} == {
        1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", None: "block", 11: "block", 12: "allow"
    }
    assert got[1].rule == "example.net/en/" and got[2].rule == "net/" and got[3].rule is None
    assert (got[1].host, got[1].path, got[2].path) == ("a.example.net", "/en/1", "/x")
    assert (got[7].host, got[7].path, got[8].host) == ("", "", "")
    assert got[12].alias_root == 6
    without = [r for r in rows if r[0] != 5]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(without, "page_id long, url string, html string")).collect()}
    assert got[3] == got[4] == "block"


def test_links_are_resolved_against_their_page(spark):
    from urllib.parse import urljoin

    page = "https://Host.org/a/b/c.html?x=1#f"
    links = ["../q", "page.html", "?y=2", "/r", "//other.org/z", "http://full.org/", "./d/../e", "../../../top", "g?u=http://n.org/", "sub/", ".."]
    rows = [(k, page, f'<link rel="canonical" href="{v}">') for k, v in enumerate(links)]
    rows += [(100, page, "<link rel=canonical href='/r?a=1&amp;b=2'>"), (101, page, '<meta property="og:url" content="#top">'), (102, page, '<link rel="canonical" href="mailto:x@y.org">')]
    df = spark.createDataFrame(rows, "k int, url string, html string")
    got = {r.k: r.t for r in df.select("k", url_filter.targets(F.col("html"), F.col("url")).alias("t")).collect()}
    for k, v in enumerate(links):
        want = urljoin(page, v)
        assert [x.rstrip("/") for x in got[k]] == [want.rstrip("/")], (v, got[k], want)
    assert got[100] == ["https://Host.org/r?a=1&b=2"] and got[101] == [] and got[102] == []


def test_links_in_comments_odd_attributes_bases_dots_and_ports(spark):
    page = "http://h.org/a/b.html"
    link = lambda href, more="": f'<link rel="canonical"{more} href="{href}">'
    cases = [
        (link("http://q.net/k", ' data-href="/no"'), ["http://q.net/k"]),
        ('<link data-rel="canonical" href="/no"><meta data-property="og:url" content="/no">', []),
        (f"<!-- {link('/no')} -->{link('/yes')}<!-- {link('/open')}", ["http://h.org/yes"]),
        (f'<base target="_top"><base href="/c/d/">{link("e")}{link("../f")}<base href="/later/">', ["http://h.org/c/d/e", "http://h.org/c/f"]),
        (f'<base href="https://else.com/x/y">{link("z")}', ["https://else.com/x/z"]),
        (link("/a/../b") + link("http://y.io/a/./c/../../b?q=/../x") + link("//y.io/a/.."), ["http://h.org/b", "http://y.io/b?q=/../x", "http://y.io/"]),
        (link("http://y.io:80/p") + link("https://y.io:443") + link("https://y.io:80/p") + link("http://y.io:/p"), ["http://y.io/p", "https://y.io", "https://y.io:80/p", "http://y.io/p"]),
        ('<link rel="alternate canonical" href="/two">', ["http://h.org/two"]),
        ("<p>" * 100_000 + "<!--" + "x" * 300_000 + "-->" + link("/far"), ["http://h.org/far"]),
        (None, None),
    ]
    df = spark.createDataFrame([(k, page, h) for k, (h, _) in enumerate(cases)], "k int, url string, html string")
    got = {r.k: r.t for r in df.select("k", url_filter.targets(F.col("html"), F.col("url")).alias("t")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k] == want, (k, got[k], want)
    same = [("http://y.io:80/a/../b/", "https://www.y.io/b"), ("https://Y.io:443", "http://y.io/."), ("http://y.io:8080/", "http://y.io:8080")]
    for x, y in same + [("http://y.io:443/", "http://y.io")]:
        a, b = spark.createDataFrame([(x,), (y,)], "u string").select(url_filter.canonical(F.col("u"))).collect()
        assert (a == b) == ((x, y) in same), (x, y)
    # A dotted link leads to a blocked address.
    rows = [(1, "https://ok.com/1", link("http://b.net/x/../y")), (2, "https://ok.com/2", link("http://b.net:80/z"))]
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"block"}


def test_urls_of_linked_pages_equal_plain_code(spark):
    """Chains, loops and stars of links over generated pages, repeated ids, long pages and clashing columns."""
    import random

    r = random.Random(4)
    hosts = ["a.net", "x.example.net", "b.com", "example.com", "c.org", "d.com", "e.io"]
    at = [f"{r.choice(hosts)}/{r.choice(['en', 'de', 'fr', 'p'])}/{k % 60}" for k in range(120)]
    named = {k: [r.randrange(120) for _ in range(r.choice([0, 0, 0, 1, 1, 2]))] for k in range(120)}
    named |= {k: [k + 1] for k in range(100, 119)} | {119: [100]}  # a loop
    rows = []
    for k in range(120):
        links = "".join(r.choice(['<link rel="canonical" href="{}">', '<meta property="og:url" content="{}">', '<meta http-equiv=refresh content="5; url={}">']).format(f"https://{at[j]}") for j in named[k])
        rows.append((k, f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.'])}{at[k]}{r.choice(['', '/', '#f', '?utm_source=x'])}", "<p>" * (200_000 if k == 7 else 3) + links, "h", "v"))
    rows.append((5, "https://lonely.io/", None, "h", "v"))  # repeats a page_id
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

    def own(host, path):
        fits = [x for x in rules if (host == (h := x[: x.index("/")]) or host.endswith("." + h)) and path.startswith(x[x.index("/") :])]
        return rules[max(fits, key=len)] if fits else None

    group = list(range(120))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    first = {}
    for k in range(120):
        for j in [k, *named[k]]:
            a, b = sorted((find(k), find(first.setdefault(at[j], k))))
            group[b] = a
    said, size = {}, {}
    for k in range(120):
        size[find(k)] = size.get(find(k), 0) + 1
        for j in [k, *named[k]]:
            host, _, rest = at[j].partition("/")
            said.setdefault(find(k), set()).add(own(host, "/" + rest))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string").withColumn("named", F.lit(1)).repartition(3)
    got = [x for x in url_filter.judge(pages).collect() if x.host != "lonely.io"]
    assert len(got) == 120
    for x in got:
        k = x.page_id
        told = said[find(k)]
        want = own(x.host, x.path) or ("allow" if "allow" in told else "block" if "block" in told else "allow")
        assert (x.verdict, x.alias_root) == (want, find(k)), (x, told)
    assert {x.verdict for x in got if not x.rule} == {"allow", "block"} and max(size.values()) > 15


def test_urls_of_no_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(1, 1)] + [(900 + k, 900 + (k + 1) % 9) for k in range(9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 500 for k in range(500, 700)}, **{900 + k: 900 for k in range(9)}}


# ---------------------------------------------------------------- 2


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rule_statistics_equal_plain_code(docs, odd):
    for table in (docs, odd.where("doc_id is not null and doc_id <> 4")):
        text = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
        got = {r.doc_id: tuple(r[1:6]) for r in quality_rules.statistics(table).collect()}
        assert got == {i: plain_stats(t) for i, t in text.items()}


def test_anomalies_are_junk_and_clean_texts_stay(docs, labels):
    got = quality_rules.judge(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    passed = got[~got.base_failed]
    assert passed.kept[passed.quality == 1].mean() > 0.97
    assert passed.kept[passed.quality == 0].mean() < 0.4


def test_forest_scores_equal_path_lengths_by_recursion():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)), 1)
    forest = quality_rules.grow(x, trees=20, tree_rows=64)

    def path(tree, row, at=0, depth=0):
        f = forest.feature[tree][at]
        if f < 0:
            assert forest.length[tree][at] >= depth
            return forest.length[tree][at]
        return path(tree, row, forest.left[tree][at] + int(row[f] >= forest.cut[tree][at]), depth + 1)

    usual = 2 * (np.log(63) + 0.5772156649) - 2 * 63 / 64
    want = [2 ** (-np.mean([path(t, row) for t in range(20)]) / usual) for row in x[:50]]
    assert np.allclose(forest.score(x[:50]), want)


def test_threshold_rejects_at_most_what_it_may(docs, labels):
    got = quality_rules.judge(docs, labels).toPandas()
    marked = got[~got.base_failed].merge(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).toPandas(), on="doc_id")
    steps = np.ceil(marked.anomaly * 1000).astype(int)
    limit = int(np.ceil(got[got.kept].anomaly.max() * 1000))
    gain = lambda at: (steps[marked.quality == 0] > at).mean() - (steps[marked.quality == 1] > at).mean()
    allowed = [t for t in range(1001) if (steps[marked.quality == 1] > t).mean() <= quality_rules.MAX_LOST]
    assert abs(gain(limit) - max(map(gain, allowed))) < 1e-9


def test_quality_rules_on_odd_rows(odd, none, labels):
    got = quality_rules.judge(odd, labels.where("false")).collect()
    assert len(got) == 9 and not any(r.kept for r in got)  # the long text repeats itself
    assert quality_rules.judge(none, labels).count() == 0


# ---------------------------------------------------------------- 3


def test_mix_on_odd_rows(odd, none):
    got = mixing.mix(odd, range_rows=2).collect()
    assert len(got) == 9 and sum(r.size == 0 for r in got) == 3
    by = {r.source: (r.source_size, r.target) for r in got}
    assert set(by) == {None, "a", "b", ""} and by[None] == (0, 0.0)
    for s, (size, target) in by.items():
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(target) and target <= 2 * size
        assert all(r.taken <= 2 * r.size for r in own)
    assert mixing.mix(none).count() == 0


def test_mix_does_not_depend_on_ranges_or_partitions(docs):
    take = lambda d, n: sorted((r.doc_id, r.taken) for r in mixing.mix(d, range_rows=n).collect())
    assert take(docs, 7) == take(docs.repartition(5), 10_000)


# ---------------------------------------------------------------- 4


def test_lm_scores_broadcast_and_sliced_agree(docs, labels, odd):
    good = labels.where("quality = 1")
    one = {r.doc_id: r for r in lm_score.score(docs, good).collect()}
    two = {r.doc_id: r for r in lm_score.score(docs, good, max_broadcast=0, slice_docs=50).collect()}
    assert len(one) == docs.count() and one.keys() == two.keys()
    for i, r in one.items():
        assert r.n_tokens == two[i].n_tokens and (r.score is None or abs(r.score - two[i].score) < 1e-6)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    mean = lambda q: sum(one[i].score for i in marked if marked[i] == q and one[i].score is not None) / sum(marked[i] == q for i in marked)
    assert mean(1) < mean(0)
    got = lm_score.score(odd, good).collect()
    assert len(got) == 9 and [r.score for r in got if r.n_tokens == 0] == [None, None]


def test_lm_scores_equal_plain_counts(spark):
    texts = {1: "abab", 2: "abba b", 3: ""}
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    import math

    def counts(ids):
        c = Counter()
        for i in ids:
            t = "\2\2\2" + texts[i]
            for k in range(3, len(t)):
                for n in range(1, 5):
                    c[t[k - n + 1 : k + 1]] += 1
        return c

    def loss(t, c, scale, vocabulary):
        total, t = 0.0, "\2\2\2" + t
        for k in range(3, len(t)):
            p = 1 / (vocabulary + 1)
            for n in range(1, 5):
                g = t[k - n + 1 : k + 1]
                context = sum(v for x, v in c.items() if len(x) == n and x[:-1] == g[:-1])
                p = (c[g] * scale + lm_score.PRIOR * p) / (context * scale + lm_score.PRIOR)
            total -= math.log(p)
        return total / (len(t) - 3)

    target, back = counts([1]), counts([1, 2, 3])
    for i in (1, 2):
        assert abs(got[i].target_loss - loss(texts[i], target, 1.0, 3)) < 1e-6
        assert abs(got[i].background_loss - loss(texts[i], back, 4 / 10, 3)) < 1e-6
    assert got[3].score is None


# ---------------------------------------------------------------- 5, 9


def test_language_is_right_on_held_out_rows(docs):
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    test = got[got.held_out & (got.lang_pred != "und")]
    assert (test.lang_pred == test.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_of_odd_rows(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == 9 and sorted(r.doc_id for r in got if r.lang_pred == "und") == [1, 2, 3, 7]
    assert langid.identify(none).count() == 0


def test_languages_equal_plain_naive_bayes(spark):
    import math

    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "le chat et le chien", "fr"), (5, "a dog", "en"), (7, "", "xx")]
    asked = [(100, "the chat und dog"), (101, "Katze " * 500 + "the"), (102, "éé"), (103, "die")]
    buckets = 64
    langs, logp = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), buckets=buckets)
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string").repartition(2), langs, logp).collect()}
    count, n_docs = {}, Counter(r[2] for r in rows)
    for _, text, lang in rows:
        own = count.setdefault(lang, Counter())
        for g in langid.grams(text, buckets=buckets):
            own.update(g.tolist())
    assert langs == sorted(count)
    for i, text in asked:
        seen = [b for g in langid.grams(text, buckets=buckets) for b in g.tolist()]
        total = {}
        for lang, own in count.items():
            total[lang] = math.log((n_docs[lang] + 0.5) / (len(rows) + 0.5 * len(count)))
            total[lang] += sum(math.log((own[b] + 0.5) / (sum(own.values()) + 0.5 * buckets)) for b in seen)
        best = max(total, key=total.get)
        weight = sum(math.exp((v - total[best]) / math.sqrt(len(seen))) for v in total.values())
        assert got[i].lang_pred == best and abs(got[i].score - 1 / weight) < 1e-4


def test_many_languages_shrink_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_CELLS", 1 << 17)
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(500)]
    langs, logp = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(langs) == 500 and logp.shape == (257, 500)


def test_quality_ranker_with_conflicting_labels_and_repeated_rows(spark, docs, labels):
    odd_labels = labels.unionByName(labels.limit(20).withColumn("quality", 1 - F.col("quality")))
    many = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("other")))
    one = quality_ranker.rank(many, odd_labels).toPandas().groupby("doc_id").score.max()
    two = quality_ranker.rank(many.repartition(5), odd_labels.orderBy(F.desc("quality")).repartition(3)).toPandas().groupby("doc_id").score.max()
    assert abs(one - two).max() < 1e-9


def test_preference_weights_minimise_the_logistic_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    good = x @ [2.0, -1.0, 0.0] + rng.normal(size=60) > 0
    w = quality_ranker.fit(x, good)
    # Plain gradient steps over the same pairs end at the same weights.
    rng = np.random.default_rng(5)
    plus, minus = np.flatnonzero(good), np.flatnonzero(~good)
    n = 20 * max(len(plus), len(minus))
    deal = lambda part: np.concatenate([rng.permutation(part) for _ in range(-(-n // len(part)))])[:n]
    diff = x[deal(plus)] - x[deal(minus)]
    v = np.zeros(3)
    for _ in range(20_000):
        v += 0.5 * (diff.T @ (1 / (1 + np.exp(diff @ v))) / n - quality_ranker.RIDGE * v)
    assert abs(w - v).max() < 1e-3


def test_quality_ranker_on_held_out_rows(docs, labels):
    got = quality_ranker.rank(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    test = got[got.held_out]
    assert (test.predicted == test.quality).mean() > 0.9
    assert got.score.between(0, 1).all()
    again = quality_ranker.rank(docs.repartition(4), labels.repartition(3)).toPandas()
    assert abs(again.set_index("doc_id").score - got.set_index("doc_id").score).max() < 1e-9


def test_noise_in_place_of_words_is_not_good(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_ranker.learn(docs, labels)
    rows = docs.join(labels.where("quality = 1"), "doc_id").where(quality_ranker.held_out(F.col("doc_id"))).limit(100).collect()
    good = [r for r in rows if model.score([r.text])[0] >= 0.3]
    noise = model.score([quality_ranker.scrambled(r.text, 99 + r.doc_id) for r in good])
    assert len(good) > 0.9 * len(rows) > 30 and (noise >= 0.3).mean() < 0.1
    # A few unknown words, or none at all, say nothing.
    assert abs(model.score(["Zzyx."])[0] - model.score(["The."])[0]) < 0.4 and model.known.told([]) == 3.0


def test_threshold_stands_where_fewest_are_wrong():
    """Of the quantiles that reject 0.8 to 1.2 times the bad ones the middle of those with the fewest errors, by trying all."""
    rng = np.random.default_rng(8)
    for n, share, gap in ((50, 0.2, 3.0), (200, 0.1, 1.0), (30, 0.5, 0.5), (10, 0.0, 1.0), (10, 1.0, 1.0)):
        good = np.arange(n) >= n * share
        raw = rng.normal(size=n) + gap * good
        shift, scale = quality_ranker.calibrate(raw, good, 0.3)
        predicted = 1 / (1 + np.exp(-scale * (raw - shift))) >= 0.3
        bad = int((~good).sum())
        if bad in (0, n):
            assert predicted.all()
            continue
        order = sorted(raw)
        wrong = {}
        for k in range(1, n):
            if 0.8 * bad - 0.5 <= k <= 1.2 * bad + 0.5:
                at = (order[k - 1] + order[k]) / 2
                wrong[k] = sum((r < at) == g for r, g in zip(raw, good, strict=True))
        assert (predicted != good).sum() == min(wrong.values())
        assert wrong[int((~predicted).sum())] == min(wrong.values())


def test_quality_ranker_on_odd_rows(odd, none, labels):
    assert quality_ranker.rank(odd, labels).count() == 9
    assert [r.predicted for r in quality_ranker.rank(odd, labels.where("false")).collect()] == [1] * 9
    assert quality_ranker.rank(none, labels).count() == 0


# ---------------------------------------------------------------- 6


def test_length_table_answers_every_limit(spark, docs):
    lengths = [r.n_tokens for r in token_counts.encoded_lengths(docs).collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(docs)), block=50).cache()
    for r in sums.collect():
        assert r.docs_at_least == sum(n >= r.n_tokens for n in lengths) and r.tokens_at_least == sum(n for n in lengths if n >= r.n_tokens)
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
    limits = [0, 1, 7, 100, 333, max(lengths), max(lengths) + 5]
    got = {r.limit: r.truncated_total for r in token_counts.truncated_totals(sums, spark.createDataFrame([(x,) for x in limits], "limit long")).collect()}
    assert got == {x: sum(min(n, x) for n in lengths) for x in limits}
    ranked = sorted(lengths)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 0.99]).collect():
        assert r.n_tokens == next(n for n in ranked if sum(x <= n for x in lengths) >= r.share * len(lengths) - 1e-9)


def test_lengths_of_odd_rows_and_pieces(odd, none):
    got = {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(odd).collect()}
    assert got[1] == got[2] == 0 and got[4] > 100_000
    assert token_counts.length_table(none).count() == 0
    text = "one two  three\nfour 5 six " * 50
    parts = list(token_counts.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 5
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts._encoder(f.read(), token_counts.PATTERN).encode_ordinary
    assert sum(len(encode(p)) for p in parts) == len(encode(text))


# ---------------------------------------------------------------- 7


def test_fingerprints_follow_the_definition():
    import xxhash

    text = "The quick\tBROWN fox\x0bjumps Ä over the quick brown fox jumps"
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_golay_keys_meet_for_up_to_four_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300).astype(np.int64)
    for bits in range(5):
        for v in base:
            e = np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
            pair = np.array([v, (np.uint64(v) ^ e).astype(np.int64)])
            row, key = simhash.block_keys(pair)
            assert set(key[row == 0]) & set(key[row == 1])


@pytest.mark.parametrize("block", [20_000, 5])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 20)
    fps = [int(b) for b in base] + [0]
    for b in base:
        for _ in range(12):
            fps.append(int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(1, 7), replace=False)))
    fps = list(dict.fromkeys(fps))
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block)
    got = {r.node: r.root for r in components(links).collect()}
    want = groups({f: f for f in fps}, 4)
    assert {f: got.get(f, f) for f in fps} == want


def test_near_duplicates_of_odd_rows(odd, none, docs):
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(odd).collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5), (7, 7), (8, 8)]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8]
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == groups(fps, 4)


# ---------------------------------------------------------------- 10


def test_leaks_equal_brute_force(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(docs, items).collect()}
    text = lambda df, k: {r[k]: r.text for r in df.collect()}
    want = benchmark_leaks(text(docs, "doc_id"), text(items, "item_id"))
    assert got == {k: round(v, 9) for k, v in want.items()} and got


def test_leaks_with_edits_short_items_and_odd_rows(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(40))
    edited = "xx yy " + item.replace("w39", "Q").upper() + " zz"
    broken = item.replace("w10", "Q").replace("w25", "R")
    rows = [(100, edited), (101, broken), (102, item[: len(item) // 2]), (103, "a b c"), (104, item), (104, item)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    table = odd.unionByName(extra, allowMissingColumns=True)
    items = spark.createDataFrame([(1, item), (1, item), (2, "b C"), (3, None), (4, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word) for r in decontaminate.leaks(table, items).collect())
    assert got == [(100, 1, 2), (103, 2, 1), (104, 1, 0), (104, 1, 0)]
    kept = decontaminate.clean(table, items)
    assert kept.columns == table.columns and kept.count() == 9 + 2
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.clean(odd, items.where("false")).count() == 9


def test_leaks_of_repeated_items_null_ids_and_two_texts_of_one_id(spark):
    item = "a " * 16 + "b c d e f g h i"
    rows = [(1, "a " * 24), (2, " ".join(f"x{i}" for i in range(30))), (3, " ".join(f"y{i}" for i in range(30))), (4, item)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    odd_items = [(1, item), (1, item), (2, rows[1][1]), (2, rows[2][1].upper()), (None, rows[1][1])]
    items = spark.createDataFrame(odd_items, "item_id long, text string").selectExpr("*", "'x' AS item", "1 AS words", "2 AS size")
    got = sorted((r.doc_id, r.item_id or -1, r.similarity) for r in decontaminate.leaks(table, items).collect())
    assert got == [(2, -1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 1, 1.0)]
    assert [r.doc_id for r in decontaminate.clean(table, items).collect()] == [1]


def test_leaks_of_large_benchmarks_are_joined_by_shuffle(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = lambda: sorted((r.doc_id, r.item_id, r.start_word) for r in decontaminate.leaks(docs, items).collect())
    one = found()
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert found() == one and one


def test_queries_of_the_operators_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert F is not None


def test_urls_of_the_pages_table_equal_plain_code(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    own, keys = {}, {}
    for r in pages.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", r.url or "")
        host, path, query = (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")
        fits = [x for x in rules if (host == (h := x[: x.index("/")]) or host.endswith("." + h)) and path.startswith(x[x.index("/") :])]
        own[r.page_id] = (host, path, max(fits, key=len, default=None))
        kept = "&".join(sorted(p for p in query.split("&") if p and not re.match("utm_[a-z]+=|ref=", p)))
        keys.setdefault((re.sub(r"^(www|m)\.(?=[^.]+\.)", "", host), path.rstrip("/"), kept), []).append(r.page_id)
    assert {k: (v.host, v.path, v.rule) for k, v in got.items()} == own
    for ids in keys.values():  # the pages name no other addresses, so spellings alone make aliases
        said = {rules[own[i][2]] for i in ids if own[i][2]}
        for i in ids:
            assert got[i].verdict == (rules[own[i][2]] if own[i][2] else "allow" if "allow" in said or not said else "block")
