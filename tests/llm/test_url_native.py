"""The url filter runs no Python on executors."""

from pyspark.sql import DataFrame

from witness.llm import url_filter


def test_linked_pages_take_sql_functions_only(spark, monkeypatch):
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: (_ for _ in ()).throw(AssertionError("Python on executors")))
    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://a.org/x", link("http://b.org/y")), (2, "http://b.org/y", link("http://spam.net/z")), (3, "http://c.org/", "")]
    found = {r.page_id: (r.verdict, r.alias_root) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: ("block", 1), 2: ("block", 1), 3: ("allow", 3)}
