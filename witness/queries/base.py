"""The registry and what queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witness import fixtures as X

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def secs(c: str | Column) -> Column:
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or (c if isinstance(c, str) else "x"))


def edges(items: DataFrame) -> DataFrame:
    """Membership as edges; a tenth of the items has none yet."""
    return items.where("item_id % 10 <> 7").selectExpr("item_id AS from_id", "bubble_id AS to_id", "'member_of' AS rel")


EDGES_SQL = "edges AS (SELECT item_id AS from_id, bubble_id AS to_id, 'member_of' AS rel FROM items WHERE item_id % 10 <> 7)"
MEMBERS_SQL = "members AS (SELECT i.* FROM items i JOIN edges e ON i.item_id = e.from_id)"
BUBBLES_SQL = """bubbles AS (
  SELECT bubble_id, any_value(dataset_id) AS dataset_id, count(*) AS mass, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen,
         count(DISTINCT source) AS source_diversity, list_sort(list(DISTINCT source_class)) AS source_classes, avg(lat) AS lat, avg(lng) AS lng
  FROM items GROUP BY bubble_id)"""
COORD_SQL = "coords AS (SELECT item_id, (item_id % 7) * 1.0::DOUBLE AS x, (item_id % 11) * 0.5::DOUBLE AS y, (item_id % 3) * 1.0::DOUBLE AS z, 'text' AS kind FROM items WHERE item_id % 4 <> 1)"


def coords(items: DataFrame) -> DataFrame:
    return items.where("item_id % 4 <> 1").selectExpr(
        "item_id", "(item_id % 7) * 1.0D AS x", "(item_id % 11) * 0.5D AS y", "(item_id % 3) * 1.0D AS z", "'text' AS kind"
    )


def sql(*parts: str, select: str) -> str:
    return X.with_sql(X.ITEMS_SQL, *parts, select=select)
