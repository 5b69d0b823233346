"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from witness.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Rows of a source that one sorted range holds on average.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: water-filling over one row per source (columns source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn.  Handing the excess of full sources to the
    others by weight, again and again, ends where every source has the smaller of its cap and ``level * weight``; the
    level follows from running sums over the sources in the order in which they fill up.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("_nth") % len(weights) + 1)
    all_rows = Window.partitionBy()
    fill = Window.orderBy("_ratio", "_nth").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * float(max_epochs)
    budget = F.sum("source_size").over(all_rows) * share
    left = (
        sizes.withColumn("_nth", F.row_number().over(order) - 1)
        .withColumn("_w", weight)
        .withColumn("_ratio", cap / F.col("_w"))
        .withColumn("_budget", budget)
        .withColumn("_full", F.coalesce(F.sum(cap).over(fill), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_rest"))
    )
    # Sources before the first whose cap lies above the level are full; it and those after it share what is left.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_nth", "_level"))).over(all_rows)["_level"]
    target = F.least(cap, F.coalesce(level * F.col("_w"), cap))
    return left.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = "mix", range_rows: int = RANGE_ROWS, carry: bool = False
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each row the mix takes.

    ``size`` counts words (null text: 0).  Each source's rows are put in order of the MD5 of ``seed``, doc_id and the
    text's MD5 (so that rows without an id, or with one id and different texts, spread over the ranges too); a target of several epochs takes whole ones first, then cuts the order at the exact budget, so that the last row is
    taken in part.  ``taken`` counts repeats and sums to the target, rounded down, in each source.  Null sources are a
    source of their own, as is the empty string; null ids sort first.  Rows alike in doc_id, source and size are
    interchangeable.  Empty tables give no rows.  Other columns are not looked at; with ``carry`` the input row comes
    along as the struct column ``_row``.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5("text"), F.lit(""))))
    row = [F.struct(*docs.columns).alias("_row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), key.alias("_key"), *row)
    sized = cut(rows.drop("_row"))
    rows = rows if carry else sized
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    # One row per source from here to the targets.
    goal = targets(total.select("source", "source_size"), weights, share, max_epochs)
    by_source = cut(
        goal.withColumnRenamed("source", "_s").join(total.select(F.col("source").alias("_s2"), "_n"), F.expr("_s <=> _s2")).drop("_s2")
    )
    # Keys are uniform, so equal ranges of them hold about equally many rows: as many ranges as the source needs.
    ranges = F.greatest(F.lit(1), F.ceil(F.col("_n") / range_rows)).cast("long")
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")

    def keyed(df: DataFrame) -> DataFrame:
        return (
            df.join(by_source, F.expr("source <=> _s"))
            .withColumn("_range", F.floor(place * ranges / F.lit(2.0**32)).cast("long"))
            .drop("_s", "_n")
        )

    # Prefix sums: of whole ranges over a few rows per source, then within each range.
    sums = keyed(sized).groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = sums.select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"),
        (F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum")).alias("_before"),
    )
    within = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("div(floor(target), source_size)")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least("size", budget - epochs * F.col("source_size") - start))
    return (
        keyed(rows)
        .join(before, F.expr("source <=> _s and _range = _r"))
        .withColumn("taken", (epochs * F.col("size") + part).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", *(["_row"] if carry else []))
    )


#: The same in DuckDB.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS hash_key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nth FROM sized GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
g AS (SELECT *, (budget - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
l AS (SELECT arg_min(g.level, g.ratio) AS lvl FROM g WHERE level <= ratio),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(lvl * w, 2.0::DOUBLE * source_size)) AS target FROM g, l),
o AS (SELECT z.doc_id, z.source, z.size, t.source_size, t.target,
             coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.hash_key, z.doc_id NULLS FIRST, z.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       ((CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END) * size
        + greatest(0, least(size, floor(target)::BIGINT - (CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END) * source_size - start)))::BIGINT AS taken
FROM o
"""
