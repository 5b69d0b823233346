"""The driver's tables as items of this domain: the same rows for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
AS_AT = "2024-01-15 12:00:00"
#: Of pseudonyms in the queries.
SALT = "salt"
HAZARDS = ("flooding", "wind", "slip", "fire", "other")
#: (source, reliability) of the test registry; other sources are unknown.
REGISTRY = (("src0", "A"), ("src1", "A"), ("src2", "A"), ("src3", "B"), ("src4", "C"), ("src5", "F"))
#: Appended to texts so that every class of the text rules occurs.
PHRASES = (
    "surface water over the kerb",
    "gust took roofing metal",
    "slip has closed the road",
    "smoke and burning scrub",
    "road closed by a cordon",
    "power cut, lines down",
    "burst main and no water",
    "tree down across the lane",
    "cracked facade, wall down",
    "flood and smoke at once",
    "nothing to see",
)
PLACES = ("Karori", "Island Bay", "Lower Hutt", "nowhere")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows over all cores, for much work by row: a test table is one small file that one task reads.

    Tables of as many splits as cores, or more, stay as they are.  With ``most`` no task gets more rows than about that, so
    that tasks of slow work don't grow with the table; rows are counted, which for Parquet reads no more than footers.
    """
    parts = rows.sparkSession.sparkContext.defaultParallelism
    if most:
        parts = max(parts, -(-rows.count() // most))
    return rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from ``events``."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.selectExpr(
        "event_id AS item_id",
        "ts AS occurred_at",
        "ts + make_interval(0, 0, 0, 0, 0, CAST(3 + (event_id * 7) % 6 AS INT)) AS captured_at",
        "CASE WHEN event_id % 10 = 0 THEN 'replay' ELSE 'live' END AS dataset_id",
        "concat('src', user_id % 12) AS source",
        "event_type AS source_class",
        "CASE WHEN event_type <> 'view' THEN concat('user', user_id) END AS author",
        "CASE WHEN event_id % 3 <> 0 THEN concat('x', event_id % 5000) END AS external_id",
        "CASE WHEN event_type <> 'error' THEN -41.34D + (user_id % 15) * 0.01D END AS lat",
        "CASE WHEN event_type <> 'error' THEN 174.70D + (user_id % 10) * 0.004D END AS lng",
        "CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN 1.0D ELSE 0.4D END AS geo_confidence",
        "event_id % 4 = 0 AS assumed_time",
        "concat(CASE WHEN event_id % 10 = 0 THEN 'replay' ELSE 'live' END, ':', user_id % 15, ':', unix_timestamp(ts) div 21600) AS bubble_id",
        "event_id % 6 = 0 AS verified",
        "CASE WHEN event_type IN ('purchase', 'click') THEN value / 500 END AS confidence",
        "event_id % 50 = 0 AS synthetic",
        "concat('place', user_id % 15) AS place",
        "user_id",
        "value",
        "event_type",
    ).withColumn("hazard", F.element_at(F.array(*map(F.lit, HAZARDS)), (F.col("item_id") % 5 + 1).cast("int")))


ITEMS_SQL = """items AS (
  SELECT event_id AS item_id, ts AS occurred_at, ts + to_minutes(3 + (event_id * 7) % 6) AS captured_at,
         CASE WHEN event_id % 10 = 0 THEN 'replay' ELSE 'live' END AS dataset_id,
         'src' || (user_id % 12) AS source, event_type AS source_class,
         CASE WHEN event_type <> 'view' THEN 'user' || user_id END AS author,
         CASE WHEN event_id % 3 <> 0 THEN 'x' || (event_id % 5000) END AS external_id,
         CASE WHEN event_type <> 'error' THEN -41.34::DOUBLE + (user_id % 15) * 0.01::DOUBLE END AS lat,
         CASE WHEN event_type <> 'error' THEN 174.70::DOUBLE + (user_id % 10) * 0.004::DOUBLE END AS lng,
         CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS geo_confidence,
         event_id % 4 = 0 AS assumed_time,
         (CASE WHEN event_id % 10 = 0 THEN 'replay' ELSE 'live' END) || ':' || (user_id % 15) || ':' || (floor(epoch(ts))::BIGINT // 21600) AS bubble_id,
         event_id % 6 = 0 AS verified,
         CASE WHEN event_type IN ('purchase', 'click') THEN value / 500 END AS confidence,
         event_id % 50 = 0 AS synthetic, 'place' || (user_id % 15) AS place, user_id, value, event_type,
         ['flooding', 'wind', 'slip', 'fire', 'other'][event_id % 5 + 1] AS hazard
  FROM events)"""


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "source string, reliability string")


REGISTRY_SQL = "registry(source, reliability) AS (VALUES {})".format(", ".join(f"('{s}', '{r}')" for s, r in REGISTRY))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences from ``documents``: a phrase, a place and a link are appended by doc_id."""
    phrase = "element_at(array({}), CAST(doc_id % 11 AS INT) + 1)".format(", ".join(f"'{p}'" for p in PHRASES))
    place = "element_at(array({}), CAST(doc_id % 4 AS INT) + 1)".format(", ".join(f"'{p}'" for p in PLACES))
    return dealt(read(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "lang", "source", "n_chars", "text AS body",
        f"concat(coalesce(text, ''), ' ', {phrase}, ' in ', {place}, ' https://ex.org/p/', doc_id % 50) AS text",
    )


TEXTS_SQL = """texts AS (
  SELECT doc_id, lang, source, n_chars, text AS body,
         coalesce(text, '') || ' ' || [{}][doc_id % 11 + 1] || ' in ' || [{}][doc_id % 4 + 1] || ' https://ex.org/p/' || (doc_id % 50) AS text
  FROM documents)""".format(", ".join(f"'{p}'" for p in PHRASES), ", ".join(f"'{p}'" for p in PLACES))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v", "label")


def with_sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
