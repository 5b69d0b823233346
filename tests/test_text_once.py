"""Text rules lower-case a text once and look for patterns only where their stems are."""

import random
import re

from pyspark.sql import functions as F

from witness import model
from witness.functions import text as T
from witness.operators import grade


def test_rules_equal_their_patterns(spark):
    rng = random.Random(7)
    words = "Flooded floods surface water storm water stormwater land slide landslide power cut powerless wind winds window BUS busy sh1 sh3 waves over wave over tree down roof off under water burst bank burst x main waste water coastal erosion slip\n".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(400)] + [None, "", "Poneke PŌNEKE lower hutt", "İstanbul bus"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = rows.select("id", T.hazard_of(F.col("t")).alias("h"), T.feed_hazard_of(F.col("t")).alias("f"), T.hits(F.col("t"), T.FEED_PLACES + T.FEED_PLACES).alias("p")).collect()
    first = lambda t, rules, default: next((n for n, p in rules if re.search(p, t or "", re.I | re.A)), default)
    for r in got:
        t = texts[r.id]
        assert (r.h, r.f) == (first(t, T.HAZARD_RULES, "other"), first(t, T.FEED_HAZARD_RULES, None)), t
        assert r.p == [p for p in T.FEED_PLACES if p.lower() in (t or "").lower()]


def test_issues_take_one_shuffle_of_small_rows(spark):
    words = [w for _, ws in model.ISSUES.values() for w in ws]
    rng = random.Random(3)
    rows = [(k % 40 if k % 41 else None, " ".join(rng.sample(words, rng.randint(0, 4))).upper()) for k in range(200)]
    found = grade.issue_types(spark.createDataFrame(rows, "b long, text string"), "b")
    got, said = {r.b: r.issue for r in found.collect()}, {}
    for b, t in rows:
        said.setdefault(b, []).append(t.lower())
    for b, ts in said.items():
        n = [sum(any(w in t for t in ts) for w in dict.fromkeys(ws)) for _, ws in model.ISSUES.values()]
        want = list(model.ISSUES)[n.index(max(n))] if b is not None and max(n) else model.OTHER_ISSUE
        assert got[b] == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan and "Generate" not in plan
