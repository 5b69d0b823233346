"""Quotes of a crowded address."""

from witness.operators import origins


def test_no_pair_is_shuffled(spark):
    url = "https://Ex.org/p/1/"
    rows = [("b", 1, url, [url, "http://ex.org/p/2"]), ("b", 1, url, None), ("b", 2, "http://www.ex.org/p/2", [url, "ex.org/p/1", url]), ("c", 3, url, [url]), (None, 4, url, [url])]
    found = origins.quote_links(spark.createDataFrame(rows, "bubble_id string, item_id long, url string, quoted_urls array<string>"))
    assert sorted(map(tuple, found.collect())) == [("b", 1, 2, "ex.org/p/1"), ("b", 2, 1, "ex.org/p/2")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Join"):] if "Join" in plan else plan
    before = found._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "Aggregate" not in before and "Exchange" not in before


def test_quotes_by_arrival_connect_as_all_of_them_up_to_any_time(spark):
    """Items that name and quote an address, before and after others; a link for each item and address, not for each pair."""
    from collections import Counter
    from random import Random

    from pyspark.sql import functions as F

    from witness.operators.graph import spanning_forest

    rnd = Random(3)
    url = lambda: rnd.choice((None, "http://x/1", "https://www.X/2/", "x/3", "x/4"))
    rows = [(f"b{k % 3}", k, url(), rnd.choice((None, [], [url()], [url(), url()])), rnd.randrange(60)) for k in range(240)]
    df = spark.createDataFrame(rows, "bubble_id string, item_id long, url string, quoted_urls array<string>, captured_at long")
    at = {k: (t, k) for _, k, _, _, t in rows}

    def merges(found):
        pairs = [(r.a, r.b, max(at[r.a], at[r.b])) for r in found.collect()]
        told = spanning_forest(spark.createDataFrame(pairs, "a long, b long, w struct<t:long,k:long>")).select(F.col("w.k").alias("k")).collect()
        return Counter(r.k for r in told), {frozenset(p[:2]) for p in pairs}

    (want, every), (got, some) = merges(origins.quote_links(df)), merges(origins.quote_arrivals(df))
    assert got == want and some <= every and len(want) > 50
    crowd = spark.range(600).selectExpr("'b' AS bubble_id", "id AS item_id", "'x' AS url", "array('x') AS quoted_urls", "id AS captured_at", "id AS text", "'s' AS source", "CAST(NULL AS STRING) AS author")
    assert origins.arrival_links(crowd.withColumn("text", F.lit(""))).count() <= 1200
