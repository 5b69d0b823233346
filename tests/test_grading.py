"""Facts of the rule table, the witness rules and the sentences."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from witness.operators import grade, origins

NOW = "2024-02-01 00:00:00"
FACTS = "bubble_id string, items long, origins long, reliability string, best_source string, registered long, unregistered long, location string, time string, cross_check string, cross_detail string, issue string, last_seen timestamp"


def facts(**over):
    base = {"bubble_id": "b", "items": 3, "origins": 2, "reliability": "F", "best_source": None, "registered": 0, "unregistered": 2, "location": "stated", "time": "stated",
            "cross_check": "no_applicable_layer", "cross_detail": None, "issue": "flooding", "last_seen": datetime(2024, 1, 31, 23)}
    return tuple((base | over)[c.split()[0]] for c in FACTS.split(", "))


CASES = [
    ({}, "F3", True),
    ({"origins": 1, "items": 1}, "F4", True),
    ({"cross_check": "consistent"}, "F2", True),
    ({"origins": 1, "cross_check": "consistent"}, "F3", True),
    ({"cross_check": "inconsistent"}, "F5", False),
    ({"location": "unknown"}, "F6", False),
    ({"time": "unknown"}, "F6", True),
    ({"location": "unknown", "cross_check": "inconsistent"}, "F6", False),
    ({"origins": 1, "items": 1, "reliability": "A", "best_source": "wcc"}, "A3", True),
    ({"cross_check": "inconsistent", "reliability": "A", "best_source": "wcc"}, "A5", False),
    ({"location": "unknown", "reliability": "A", "best_source": "wcc"}, "A6", False),
    ({"origins": 1, "items": 1, "reliability": "B", "best_source": "x"}, "B4", True),
]


@pytest.fixture(scope="module")
def graded(spark):
    rows = spark.createDataFrame([facts(bubble_id=str(k), **c[0]) for k, c in enumerate(CASES)], FACTS)
    return {int(r.bubble_id): r for r in grade.graded(rows, NOW).collect()}


def test_rule_table(graded):
    for k, (_, want, alert) in enumerate(CASES):
        assert graded[k].label.startswith(want + " — ") and graded[k].alert_worthy == alert, CASES[k]


def test_reasons_come_in_order_and_say_why(graded):
    first = graded[0].reasons
    assert first[0] == "2 independent origins behind 3 items — 1 collapsed as the same observation restated — independent people, not one report repeated"
    assert first[1].startswith("authoritative cross-check: no applicable layer") and first[2].startswith("source reliability F")
    assert first[-1] == "freshness 0.79 — flooding halves every 3h and the most recent report is 1.0h old"
    assert any("floored at 3" in r for r in graded[8].reasons) and any("does not overturn a contradiction" in r for r in graded[9].reasons)
    assert graded[1].alert_reasons[1].startswith("WEAK EVIDENCE: one independent origin behind 1 item —")
    assert len(graded[4].alert_reasons) == 1 and graded[4].alert_reasons[0].startswith("not raised: authoritative data contradicts")
    assert graded[5].alert_reasons[0].startswith("not raised: nothing here can be placed")


def test_confirmed_is_refused(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1,)], "c int").select(grade.checked(F.col("c"))).collect()


def test_freshness_halves_and_is_whole_in_the_future(spark):
    rows = spark.createDataFrame([("flooding", datetime(2024, 1, 31, 21)), ("structural_damage", datetime(2024, 1, 30)), ("new", datetime(2024, 1, 31, 12)), ("fire", datetime(2024, 3, 1))], "issue string, at timestamp")
    got = [r[0] for r in rows.select(grade.freshness(F.col("issue"), F.col("at"), NOW)).collect()]
    assert got == [0.5, 0.5, 0.5, 1.0]


# ---------------------------------------------------------------- witnesses

ITEM = "bubble_id string, item_id long, source string, author string, url string, quoted_urls array<string>, text string, occurred_at timestamp"
T0 = datetime(2024, 1, 1)


def item(k, text, source="s", author=None, url=None, quoted=(), bubble="b"):
    return (bubble, k, source, author, url, list(quoted), text, T0 + timedelta(minutes=k))


LONG = "river has come over the road near the old school bridge today"
ITEMS = [
    item(1, LONG),
    item(2, "RT: " + LONG),
    item(3, "a completely different observation about wind and roofs"),
    item(4, "see this", url=None, quoted=["http://WWW.ex.org/a/"]),
    item(5, "original words here that nobody else uses", url="https://ex.org/A"),
    item(6, "first by ann", author=" Ann"),
    item(7, "something else entirely by the same person", author="ann "),
    item(8, "official warning one"),
    item(9, "another notice, no author"),
    item(10, LONG, bubble="other"),
    item(11, "quoting and copying " + LONG + " ok", quoted=["https://ex.org/a"]),
]


def test_origins_collapse_and_chain(spark):
    rows = spark.createDataFrame(ITEMS, ITEM)
    for table in (rows, rows.orderBy(F.desc("item_id")).repartition(4)):
        found = origins.links(table)
        got = {r.item_id: r.origin_id for r in origins.assign_origins(table, found).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 4}
    told = {r.origin_id: r.why for r in origins.origin_groups(origins.assign_origins(rows, origins.links(rows)), origins.links(rows)).collect()}
    assert told[1] == ["near-identical wording (0.92 token overlap) — copy-paste, not corroboration"]
    assert any("a repost is not a second witness" in w for w in told[4])


def test_origins_of_nothing(spark):
    none = spark.createDataFrame([], ITEM)
    assert origins.assign_origins(none, origins.links(none)).count() == 0


def test_counts_never_exceed_items(spark):
    rows = spark.createDataFrame(ITEMS, ITEM)
    for r in origins.origin_counts(origins.author_origins(rows)).collect():
        assert 1 <= r.independent_sources <= r["items"]
