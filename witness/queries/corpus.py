"""Queries over store reads, deduplication, folding, and text and vector rules."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from witness import fixtures as X
from witness.functions import text as T
from witness.functions import vectors as V
from witness.operators import dedupe, fold, history, store
from witness.plans.lineage import shared_dir
from witness.queries.base import BUBBLES_SQL, COORD_SQL, EDGES_SQL, MEMBERS_SQL, ORACLES, coords, edges, query, r6, secs, sql

# ---------------------------------------------------------------- store reads


@query(sql(select="SELECT item_id, epoch(date_trunc('second', occurred_at))::BIGINT AS at FROM items WHERE occurred_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND dataset_id = 'live' ORDER BY occurred_at, item_id LIMIT 200"))
def p1_items_in_window(spark, sf_dir):
    found = store.items_in_window(X.items(spark, sf_dir), "2024-01-10", "2024-01-12", "live", 200)
    return found.select("item_id", secs("occurred_at").alias("at"))


@query(sql(select="SELECT floor(epoch(max(occurred_at)))::BIGINT AS at FROM items"))
def p2_latest_occurred_at(spark, sf_dir):
    return store.latest_occurred_at(X.items(spark, sf_dir)).select(secs("occurred_at").alias("at"))


@query(sql(select="SELECT item_id, source FROM items WHERE item_id IN (SELECT event_id FROM events WHERE value > 90)"))
def p3_items_by_ids(spark, sf_dir):
    ids = X.read(spark, sf_dir, "events").where("value > 90").selectExpr("event_id AS item_id")
    return store.items_by_ids(X.items(spark, sf_dir), ids).select("item_id", "source")


@query(sql(COORD_SQL, select="SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM coords)"))
def p4_without_embedding(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return store.without_embedding(items, coords(items)).select("item_id")


@query(
    "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id % 100, 's' || label, lpad(vec_id::VARCHAR, 9, '0') LIMIT 150"
)
def p5_embedded_in_order(spark, sf_dir):
    v = X.vectors(spark, sf_dir).selectExpr("*", "v AS embedding", "vec_id % 100 AS occurred_at", "concat('s', label) AS source", "lpad(string(vec_id), 9, '0') AS text")
    return store.embedded_in_order(v, 150).select("vec_id", "label")


def _bubbles(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return fold.fold_bubbles(items, ["bubble_id", "dataset_id"])


def _scored(spark, sf_dir):
    return _bubbles(spark, sf_dir).withColumn("score", F.round(fold.score(F.col("mass"), F.col("last_seen"), X.NOW), 9))


SCORED_SQL = """scored AS (SELECT *, round(mass * pow(0.5::DOUBLE, greatest(0::DOUBLE, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_seen)) / 3.6e9) / 6), 9) AS score FROM bubbles)"""


@query(sql(BUBBLES_SQL, select="SELECT bubble_id, mass FROM bubbles WHERE dataset_id = 'live' AND last_seen >= TIMESTAMP '2024-01-20' ORDER BY last_seen DESC, bubble_id DESC LIMIT 100"))
def p6_active_bubbles(spark, sf_dir):
    return store.active_bubbles(_bubbles(spark, sf_dir), "live", "2024-01-20", 100).select("bubble_id", "mass")


@query(sql(BUBBLES_SQL, SCORED_SQL, select="SELECT bubble_id, mass FROM scored WHERE last_seen >= TIMESTAMP '2024-01-28' AND first_seen <= TIMESTAMP '2024-01-30' ORDER BY score DESC, last_seen DESC, bubble_id DESC LIMIT 100"))
def p7_bubbles_overlapping(spark, sf_dir):
    return store.bubbles_overlapping(_scored(spark, sf_dir), "2024-01-28", "2024-01-30", 100).select("bubble_id", "mass")


@query(sql(BUBBLES_SQL, select="SELECT bubble_id FROM bubbles WHERE NOT (mass % 3 = 0)"))
def p8_unlabelled(spark, sf_dir):
    b = _bubbles(spark, sf_dir).withColumn("label", F.when(F.col("mass") % 3 == 0, "named"))
    return store.unlabelled(b).select("bubble_id")


def _notes(items):
    """Annotations: who verified, how sure, whether the time was assumed."""
    on = lambda key, value, when: items.where(when).selectExpr("item_id AS node_id", f"'{key}' AS key", f"{value} AS value")
    return (
        on("verified", "CASE WHEN item_id % 12 = 0 THEN 'Yes' ELSE 'no' END", "verified")
        .unionByName(on("confidence", "CASE WHEN item_id % 5 = 0 THEN '' WHEN item_id % 5 = 1 THEN 'n/a' ELSE string(confidence) END", "confidence IS NOT NULL"))
        .unionByName(on("assumed_occurred_at", "'true'", "assumed_time"))
    )


NOTES_SQL = """notes AS (
  SELECT item_id AS node_id, 'verified' AS key, CASE WHEN item_id % 12 = 0 THEN 'Yes' ELSE 'no' END AS value FROM items WHERE verified
  UNION ALL SELECT item_id, 'confidence', CASE WHEN item_id % 5 = 0 THEN '' WHEN item_id % 5 = 1 THEN 'n/a' ELSE confidence::VARCHAR END FROM items WHERE confidence IS NOT NULL
  UNION ALL SELECT item_id, 'assumed_occurred_at', 'true' FROM items WHERE assumed_time)"""


@query(sql(NOTES_SQL, select="SELECT node_id, key FROM notes WHERE node_id IN (SELECT item_id FROM items WHERE source = 'src3')"))
def p10_annotations_of(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return store.annotations_of(_notes(items), items.where("source = 'src3'").selectExpr("item_id AS node_id")).select("node_id", "key")


@query(sql(EDGES_SQL, select="SELECT from_id, to_id FROM edges WHERE from_id % 9 = 0 OR to_id LIKE 'replay:3:%'"))
def p11_edges_touching(spark, sf_dir):
    items = X.items(spark, sf_dir)
    e = edges(items).withColumn("from_id", F.col("from_id").cast("string"))
    nodes = items.where("item_id % 9 = 0").selectExpr("string(item_id) AS node_id").unionByName(items.where("bubble_id LIKE 'replay:3:%'").selectExpr("bubble_id AS node_id").distinct())
    return store.edges_touching(e, nodes).select(F.col("from_id").cast("long").alias("from_id"), "to_id")


@query(sql(X.REGISTRY_SQL, select="SELECT source, reliability FROM registry WHERE source IN (SELECT source FROM items WHERE event_type = 'purchase')"))
def p12_registry(spark, sf_dir):
    return X.registry(spark).join(X.items(spark, sf_dir).where("event_type = 'purchase'").select("source"), "source", "left_semi")


@query(sql(select="SELECT dataset_id, count(*) AS n, min(item_id) AS first_id FROM items WHERE occurred_at >= greatest((SELECT max(occurred_at) FROM items), TIMESTAMP '2024-01-15 12:00:00') - INTERVAL 48 HOUR GROUP BY 1"))
def p13_anchored_window(spark, sf_dir):
    found = store.anchored_window(X.items(spark, sf_dir), X.AS_AT, 48)
    return found.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_id"))


@query(sql(select="SELECT b.item_id FROM items b JOIN items s ON s.item_id < 5000 AND b.item_id >= 5000 AND b.dataset_id = s.dataset_id AND b.source = s.source AND b.external_id = s.external_id GROUP BY 1"))
def p14_item_by_dedupe(spark, sf_dir):
    items = X.items(spark, sf_dir)
    stored = items.where("item_id < 5000")
    return items.where("item_id >= 5000").join(stored, ["dataset_id", "source", "external_id"], "left_semi").select("item_id")


@query(sql(EDGES_SQL, select="SELECT i.item_id, e.to_id AS bubble_id FROM items i JOIN edges e ON i.item_id = e.from_id WHERE i.captured_at <= TIMESTAMP '2024-01-15 12:00:00'"))
def j1_members(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return store.members(items, edges(items), X.AS_AT).select("item_id", "bubble_id")


@query(sql(EDGES_SQL, select="SELECT item_id FROM items WHERE item_id NOT IN (SELECT from_id FROM edges)"))
def j2_pending(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return store.pending(items, edges(items)).select("item_id")


@query(sql(COORD_SQL, select="SELECT item_id FROM items WHERE source <> 'src1' AND item_id NOT IN (SELECT item_id FROM coords WHERE kind = 'text')"))
def j3_unprojected(spark, sf_dir):
    items = X.items(spark, sf_dir).withColumn("embedding", F.when(F.col("source") != "src1", F.array(F.lit(1.0))))
    return store.unprojected(items, coords(items), "text").select("item_id")


@query(sql(EDGES_SQL, COORD_SQL, select="SELECT i.item_id, c.x, c.y, c.z, e.to_id AS bubble FROM items i LEFT JOIN coords c USING (item_id) LEFT JOIN edges e ON e.from_id = i.item_id"))
def j4_points(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return store.points(items, coords(items), edges(items)).select("item_id", "x", "y", "z", "bubble")


@query(sql(X.REGISTRY_SQL, select="SELECT item_id, reliability FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN source ELSE ' ' || upper(source) END AS s FROM items) i LEFT JOIN registry r ON r.source = lower(trim(i.s))"))
def j5_registry_fallback(spark, sf_dir):
    items = X.items(spark, sf_dir).withColumn("source", F.expr("CASE WHEN item_id % 2 = 0 THEN source ELSE concat(' ', upper(source)) END"))
    return store.with_reliability(items, X.registry(spark)).select("item_id", "reliability")


@query(sql(select="""SELECT i.item_id, r.day IS NOT NULL AS same_day FROM items i
  LEFT JOIN (SELECT DISTINCT occurred_at::DATE AS day FROM items WHERE value > 99.5) r ON i.occurred_at::DATE = r.day"""))
def j12_same_day(spark, sf_dir):
    items = X.items(spark, sf_dir)
    days = items.where("value > 99.5").select(F.to_date("occurred_at").alias("day"))
    return store.same_day(items, days, "occurred_at").select("item_id", "same_day")


@query(sql(EDGES_SQL, MEMBERS_SQL, select="SELECT bubble_id, count(*) AS n_members, arg_min(source, (occurred_at, item_id)) AS first FROM members GROUP BY 1"))
def j13_scalar_subqueries(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return store.first_sentence(store.members(items, edges(items)), F.col("source"))


# ---------------------------------------------------------------- deduplication


@query(sql(select="SELECT item_id FROM items WHERE external_id IS NULL UNION ALL SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY dataset_id, source, external_id ORDER BY captured_at, item_id) AS k FROM items WHERE external_id IS NOT NULL) WHERE k = 1"))
def d1_by_external_id(spark, sf_dir):
    return dedupe.by_external_id(X.items(spark, sf_dir)).select("item_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, md5(coalesce(text, ''))")
def d2_by_words(spark, sf_dir):
    return dedupe.by_words(X.read(spark, sf_dir, "documents").withColumn("at", F.lit(0)), "lang", "text", "at", ["doc_id"]).select("doc_id")


@query(sql(select="SELECT item_id FROM items b WHERE item_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM items s WHERE s.item_id % 5 <> 0 AND s.dataset_id = b.dataset_id AND s.source = b.source AND s.external_id = b.external_id)"))
def d3_insert_if_new(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return dedupe.new_items(items.where("item_id % 5 = 0"), items.where("item_id % 5 <> 0"), ["dataset_id", "source", "external_id"]).select("item_id")


@query(sql(select="SELECT user_id, arg_max(source_class, item_id) AS source_class, max(item_id) AS version FROM items GROUP BY 1"))
def d4_upsert(spark, sf_dir):
    rows = X.items(spark, sf_dir).selectExpr("user_id", "source_class", "item_id AS version")
    return dedupe.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["user_id"], "version")


@query(sql(select="""SELECT count(*) AS total, count(*) FILTER (v = 'created') AS created, count(*) FILTER (v = 'deduped') AS deduped, count(*) FILTER (v = 'failed') AS failed FROM (
  SELECT CASE WHEN lat IS NULL THEN 'failed' WHEN external_id IS NOT NULL AND row_number() OVER (PARTITION BY lat IS NOT NULL, dataset_id, source, external_id ORDER BY item_id) > 1 THEN 'deduped' ELSE 'created' END AS v FROM items)"""))
def s3_batch_verdicts(spark, sf_dir):
    return dedupe.verdict_totals(dedupe.batch_verdicts(X.items(spark, sf_dir).withColumn("ok", F.col("lat").isNotNull())))


@query(sql(select="""SELECT item_id, collector FROM (
  SELECT item_id, occurred_at, collector, source_class, row_number() OVER (PARTITION BY item_id ORDER BY o) AS k FROM (
    SELECT item_id, occurred_at, 'official' AS source_class, 'first' AS collector, 0 AS o FROM items WHERE item_id % 3 = 0
    UNION ALL SELECT item_id, occurred_at, source_class, 'second', 1 FROM items WHERE item_id % 2 = 0)) WHERE k = 1 AND (source_class = 'official' OR occurred_at >= TIMESTAMP '2024-01-15 12:00:00')"""))
def s16_collect(spark, sf_dir):
    items = X.items(spark, sf_dir).select("item_id", "occurred_at", "source_class")
    first = items.where("item_id % 3 = 0").withColumn("source_class", F.lit("official"))
    return dedupe.collect_sources([("first", first), ("second", items.where("item_id % 2 = 0"))], X.AS_AT).select("item_id", "collector")


@query("""WITH posts AS (SELECT doc_id AS post_id, CASE WHEN doc_id % 2 = 0 THEN 'https://ex.org/p/' || (doc_id % 300) END AS url, lang AS title, text FROM documents)
SELECT min(post_id) AS post_id FROM posts GROUP BY coalesce(url, 't|' || title || '|' || left(coalesce(text, ''), 60))""")
def s15_flat_feed(spark, sf_dir):
    posts = X.read(spark, sf_dir, "documents").selectExpr("doc_id AS post_id", "CASE WHEN doc_id % 2 = 0 THEN concat('https://ex.org/p/', doc_id % 300) END AS url", "lang AS title", "text")
    return dedupe.flat_feed(posts).select("post_id")


# ---------------------------------------------------------------- folding


@query(sql(BUBBLES_SQL, select="SELECT bubble_id, mass, floor(epoch(first_seen))::BIGINT AS first_s, floor(epoch(last_seen))::BIGINT AS last_s, source_diversity, array_to_string(source_classes, ',') AS classes, round(lat, 6) AS lat, round(lng, 6) AS lng FROM bubbles"))
def f1_fold_bubbles(spark, sf_dir):
    b = fold.fold_bubbles(X.items(spark, sf_dir))
    return b.select("bubble_id", "mass", secs("first_seen").alias("first_s"), secs("last_seen").alias("last_s"), "source_diversity", F.array_join("source_classes", ",").alias("classes"), r6("lat"), r6("lng"))


@query(sql(select="SELECT bubble_id, count(*) FILTER (occurred_at >= n - INTERVAL 1 HOUR) AS velocity FROM (SELECT *, max(occurred_at) OVER (PARTITION BY bubble_id) AS n FROM items) GROUP BY 1"))
def f2_velocity(spark, sf_dir):
    return fold.velocity(X.items(spark, sf_dir))


@query(sql(BUBBLES_SQL, select="SELECT bubble_id, round(mass * pow(0.5::DOUBLE, greatest(0::DOUBLE, (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(last_seen)) / 3.6e9) / 6), 6) AS score FROM bubbles"))
def f3_score(spark, sf_dir):
    b = fold.fold_bubbles(X.items(spark, sf_dir))
    return b.select("bubble_id", r6(fold.score(F.col("mass"), F.col("last_seen"), X.AS_AT), "score"))


@query(sql(NOTES_SQL, select="""SELECT bubble_id, count(DISTINCT CASE WHEN key = 'verified' AND lower(trim(n.value)) IN ('true','yes','1','confirmed','verified') THEN node_id END) AS verified_by,
  round(avg(CASE WHEN key = 'confidence' THEN CASE WHEN trim(n.value) = '' THEN 0 ELSE TRY_CAST(n.value AS DOUBLE) END END), 6) AS confidence FROM notes n JOIN items ON item_id = node_id GROUP BY 1"""))
def f4_verification(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return fold.verification(_notes(items), items).select("bubble_id", "verified_by", r6("confidence"))


@query("SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def f5_centroids(spark, sf_dir):
    c = V.centroids(X.vectors(spark, sf_dir), "label", "v")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), r6("x"))


@query(sql(select="""SELECT bubble_id, count(*) AS mass, count(DISTINCT source) AS source_diversity, any_value(v) AS velocity, NULL::BIGINT AS verified_by FROM (
  SELECT *, count(*) FILTER (occurred_at >= n - INTERVAL 1 HOUR) OVER (PARTITION BY bubble_id) AS v FROM (SELECT *, max(occurred_at) OVER (PARTITION BY bubble_id) AS n FROM items WHERE captured_at <= TIMESTAMP '2024-01-15 12:00:00')) GROUP BY 1"""))
def f6_refold_as_at(spark, sf_dir):
    return fold.refold_as_at(X.items(spark, sf_dir), X.AS_AT).select("bubble_id", "mass", "source_diversity", "velocity", "verified_by")


@query(ORACLES["f6_refold_as_at"])
def f6_as_at_from_history(spark, sf_dir):
    """From a snapshot of five days before and the members since."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    history.add(X.items(spark, sf_dir), path)
    at = datetime.fromisoformat(X.AS_AT)
    history.advance(spark, path, at.date() - timedelta(days=5))
    return history.refold_as_at(spark, path, at).select("bubble_id", "mass", "source_diversity", "velocity", "verified_by")


@query(sql(COORD_SQL, select="SELECT bubble_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM items LEFT JOIN coords USING (item_id) GROUP BY 1"))
def f7_galaxy_centre(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return fold.galaxy_centre(items, coords(items)).select("bubble_id", *(r6(c) for c in "xyz"))


@query(sql(EDGES_SQL, BUBBLES_SQL, select="SELECT b.bubble_id, b.mass, coalesce(c, 0) AS counted FROM bubbles b LEFT JOIN (SELECT to_id, count(*) AS c FROM edges GROUP BY 1) e ON e.to_id = b.bubble_id WHERE b.mass <> coalesce(c, 0)"))
def f8_mass_mismatch(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return fold.mass_mismatch(fold.fold_bubbles(items), edges(items))


@query(sql(select="SELECT bubble_id, count(DISTINCT hazard) AS labels FROM items GROUP BY 1 HAVING count(DISTINCT hazard) > 1"))
def f9_impure(spark, sf_dir):
    return fold.impure(X.items(spark, sf_dir))


@query(sql(select="SELECT place, count(*) AS n_records, count(DISTINCT author) AS originators, array_to_string(list_sort(list(DISTINCT source_class)), ',') AS bands FROM items GROUP BY 1"))
def f10_originators(spark, sf_dir):
    o = fold.originators(X.items(spark, sf_dir), "place", "author", "source_class")
    return o.select("place", "n_records", "originators", F.array_join("bands", ",").alias("bands"))


@query(sql(select="""SELECT b.bubble_id, h.v || ' — ' || p.v AS label FROM (SELECT DISTINCT bubble_id FROM items) b
  JOIN (SELECT bubble_id, arg_min(hazard, (-n, hazard)) AS v FROM (SELECT bubble_id, hazard, count(*) AS n FROM items GROUP BY 1, 2) GROUP BY 1) h USING (bubble_id)
  JOIN (SELECT bubble_id, arg_min(place, (-n, place)) AS v FROM (SELECT bubble_id, place, count(*) AS n FROM items GROUP BY 1, 2) GROUP BY 1) p USING (bubble_id)"""))
def f11_labels(spark, sf_dir):
    return fold.labels(X.items(spark, sf_dir))


@query(sql(select="SELECT source_class, count(*) AS n FROM items GROUP BY 1"))
def f12_counts(spark, sf_dir):
    return fold.counts_by(X.items(spark, sf_dir), "source_class")


# ---------------------------------------------------------------- vectors


@query("""SELECT a.vec_id, round(coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0), 6) AS cosine
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def v1_cosine(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    w = v.selectExpr("vec_id - 1 AS vec_id", "v AS w")
    return v.join(w, "vec_id").select("vec_id", r6(V.cosine(F.col("v"), F.col("w")), "cosine"))


@query()
def v2_sparse_embedding(spark, sf_dir):
    return V.sparse_embedding(X.read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "i", r6("w"))


@query()
def v4_projection(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    fitted = V.fit_projection(v, "v", ["vec_id"])
    return V.project(v, "v", *fitted).select("vec_id", r6("x"), r6("y"), r6("z"))


@query("SELECT vec_id, " + ", ".join(f"round((SELECT sum((e - 0.1) * CASE WHEN (i - 1) % 3 = {k} THEN 1.0 ELSE -0.5 END) FROM (SELECT unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i)), 6) AS {c}" for k, c in enumerate("xyz")) + " FROM embeddings")
def v5_project(spark, sf_dir):
    axes = [[1.0 if i % 3 == k else -0.5 for i in range(64)] for k in range(3)]
    return V.project(X.vectors(spark, sf_dir), "v", [0.1] * 64, axes).select("vec_id", r6("x"), r6("y"), r6("z"))


# ---------------------------------------------------------------- text rules


def _case(rules, text="lower(text)"):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in rules)


def texts(select: str) -> str:
    return X.with_sql(X.TEXTS_SQL, select=select)


@query(texts(f"SELECT doc_id, {_case(T.HAZARD_RULES)} ELSE 'other' END AS hazard FROM texts"))
def t1_hazard(spark, sf_dir):
    return X.texts(spark, sf_dir).select("doc_id", T.hazard_of(F.col("text")).alias("hazard"))


@query(texts(f"SELECT doc_id, {_case(T.FEED_HAZARD_RULES)} END AS hazard FROM texts"))
def t2_feed_hazard(spark, sf_dir):
    return X.texts(spark, sf_dir).select("doc_id", T.feed_hazard_of(F.col("text")).alias("hazard"))


_PLACES = sorted(T.GAZETTEER, key=lambda p: -len(p))


@query(texts("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b{p}\\b') THEN '{p}'" for p in _PLACES) + " END AS place FROM texts"))
def t3_place(spark, sf_dir):
    return X.texts(spark, sf_dir).select("doc_id", T.place_of(F.col("text"))["place"].alias("place"))


def _hits(terms):
    return f"list_filter([{', '.join(repr(t) for t in terms)}], lambda t: contains(lower(text), lower(t)))"


@query(texts(f"SELECT doc_id, array_to_string(p, '|') AS places, p[1] AS best_guess, len(p) > 0 AS is_locatable FROM (SELECT doc_id, {_hits(T.FEED_PLACES)} AS p FROM texts)"))
def t4_text_location(spark, sf_dir):
    t = X.texts(spark, sf_dir).select("doc_id", T.text_location(F.col("text")).alias("l"))
    return t.select("doc_id", F.array_join("l.places", "|").alias("places"), "l.best_guess", "l.is_locatable")


@query(texts(f"""SELECT doc_id, c IS NOT NULL AND len(p) > 0 AND NOT list_contains(p, c) AS conflict, CASE WHEN c IS NOT NULL THEN 'check_in' WHEN len(p) > 0 THEN 'text_mention' ELSE 'none' END AS signal
FROM (SELECT doc_id, {_hits(T.FEED_PLACES)} AS p, CASE doc_id % 3 WHEN 0 THEN 'Karori' WHEN 1 THEN 'Petone' END AS c FROM texts)"""))
def t5_check_in(spark, sf_dir):
    t = X.texts(spark, sf_dir).selectExpr("doc_id", "text", "CASE doc_id % 3 WHEN 0 THEN 'Karori' WHEN 1 THEN 'Petone' END AS c")
    p = T.hits(F.col("text"), T.FEED_PLACES)
    return t.select("doc_id", T.check_in_conflict(F.col("c"), p).alias("conflict"), T.location_signal(F.col("c"), p).alias("signal"))


@query(texts(f"SELECT doc_id, array_to_string(list_sort({_hits(T.PLACE_TERMS)}), '|') AS places, array_to_string(list_sort({_hits(T.IMPACT_TERMS)}), '|') AS impacts FROM texts"))
def t6_hints(spark, sf_dir):
    t = F.col("text")
    return X.texts(spark, sf_dir).select("doc_id", F.array_join(T.sorted_hits(t, T.PLACE_TERMS), "|").alias("places"), F.array_join(T.sorted_hits(t, T.IMPACT_TERMS), "|").alias("impacts"))


@query(texts(f"SELECT doc_id FROM (SELECT *, ['Wellington', 'NewZealand', 'casualnz', 'aww'][doc_id % 4 + 1] AS sub FROM texts) WHERE lower(sub) = 'wellington' OR (lower(sub) IN ('newzealand', 'casualnz') AND len({_hits(T.PLACE_TERMS)}) > 0)"))
def t7_keep_post(spark, sf_dir):
    t = X.texts(spark, sf_dir).withColumn("sub", F.expr("element_at(array('Wellington', 'NewZealand', 'casualnz', 'aww'), CAST(doc_id % 4 + 1 AS INT))"))
    return t.where(T.keep_post(F.col("sub"), F.col("text"))).select("doc_id")


_WARN = "['Orange Warning', 'red warning', 'heavy rain watch', 'a warning', 'calm'][doc_id % 5 + 1]"


@query(texts(f"SELECT doc_id, CASE WHEN contains(t, 'red warning') THEN 'red' WHEN contains(t, 'orange warning') THEN 'orange' WHEN contains(t, 'watch') THEN 'watch' WHEN contains(t, 'warning') THEN 'warning' END AS level FROM (SELECT doc_id, lower(text || ' ' || {_WARN}) AS t FROM texts)"))
def t8_warning_level(spark, sf_dir):
    t = F.concat_ws(" ", "text", F.expr("element_at(array('Orange Warning', 'red warning', 'heavy rain watch', 'a warning', 'calm'), CAST(doc_id % 5 + 1 AS INT))"))
    return X.texts(spark, sf_dir).select("doc_id", T.warning_level(t).alias("level"))


@query(sql(select=f"SELECT item_id, 'anon-' || left(sha256('{X.SALT}:' || lower(upper(author))), 12) AS salted, 'anon:' || left(sha256(author), 12) AS plain FROM items"))
def t9_pseudonym(spark, sf_dir):
    a = F.col("author")
    return X.items(spark, sf_dir).select("item_id", T.pseudonym(F.upper(a), X.SALT).alias("salted"), T.plain_pseudonym(a).alias("plain"))


@query(texts("SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS links FROM (SELECT doc_id, list_filter(u, lambda x, i: list_position(u, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(text || ' ' || text, 'https?://[^\\s<>\"'')]+') AS u FROM texts))"))
def t10_urls(spark, sf_dir):
    t = F.concat_ws(" ", "text", "text")
    return X.texts(spark, sf_dir).select("doc_id", F.array_join(T.urls(t), "|").alias("links"))


@query()
def t11_redact(spark, sf_dir):
    t = F.concat_ws(" ", F.lit("Blockage"), F.col("doc_id").cast("string"), F.lit("Pringle Street, 50 mm main 19A-21 THE TERRACE"), "text")
    return X.texts(spark, sf_dir).select("doc_id", T.redact_house_numbers(t).alias("text"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def t12_strip_html(spark, sf_dir):
    return X.read(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(c), '(v\\.redd\\.it|youtube\\.com|youtu\\.be|\\.mp4\\b)') THEN 'video' WHEN regexp_matches(lower(c), '\\.(jpg|jpeg|png|gif|webp)\\b') THEN 'photo' WHEN l IS NOT NULL THEN 'link' ELSE 'none' END AS media FROM (SELECT page_id, url || ['.jpg', ' youtu.be/x', '', ' '][page_id % 4 + 1] AS c, CASE WHEN page_id % 4 = 2 THEN url END AS l FROM pages)")
def t13_media(spark, sf_dir):
    p = X.read(spark, sf_dir, "pages").selectExpr("page_id", "concat(url, element_at(array('.jpg', ' youtu.be/x', '', ' '), CAST(page_id % 4 + 1 AS INT))) AS c", "CASE WHEN page_id % 4 = 2 THEN url END AS l")
    return p.select("page_id", T.media_of_post(F.col("c"), F.col("l")).alias("media"))


@query(texts("SELECT doc_id, trim(regexp_replace('_' || source || '-' || lang, '[_-]+', ' ', 'g')) AS key, regexp_replace(lang || '.,; ', '[.:;,\\s]+$', '') AS cut FROM texts"))
def t14_humanise(spark, sf_dir):
    t = X.texts(spark, sf_dir)
    return t.select("doc_id", T.humanise(F.concat(F.lit("_"), "source", F.lit("-"), "lang")).alias("key"), T.strip_end(F.concat("lang", F.lit(".,; "))).alias("cut"))


@query(sql(select="SELECT item_id, CASE WHEN item_id % 5 = 4 THEN NULL ELSE strftime(date_trunc('second', occurred_at), '%Y-%m-%dT%H:%M:%SZ') END AS at FROM items"))
def t15_instant(spark, sf_dir):
    f = lambda p: F.date_format("occurred_at", p)
    written = F.when(F.col("item_id") % 5 == 0, F.concat(f("EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))).when(
        F.col("item_id") % 5 == 1, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    ).when(F.col("item_id") % 5 == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(F.col("item_id") % 5 == 3, f("yyyy-MM-dd HH:mm:ss")).otherwise("last Tuesday")
    return X.items(spark, sf_dir).select("item_id", T.iso(T.instant(written)).alias("at"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS m, left(sha256(coalesce(text, '')), 16) AS s, left(sha256(left(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g'), 200)), 12) AS blanks, left(sha256(left(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 120)), 12) AS letters FROM documents")
def t16_digests(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    d = X.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(t).alias("m"), F.left(F.sha2(t, 256), F.lit(16)).alias("s"), T.fingerprint(t).alias("blanks"), T.fingerprint(t, False, 120).alias("letters"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def t17_json_field(spark, sf_dir):
    return X.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query()
def t0_enrich_items(spark, sf_dir):
    return T.enrich_items(X.texts(spark, sf_dir).select("doc_id", "text")).drop("text")
