"""Queries over published reads, the adapter, sources, weather tables and the batch twins of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from witness import fixtures as X
from witness.functions import geo
from witness.functions import text as T
from witness.functions import vectors as V
from witness.operators import adapt as A
from witness.operators import fold, grade, origins, spatial, weather
from witness.plans import reads
from witness.plans.lineage import cut
from witness.queries.base import BUBBLES_SQL, COORD_SQL, EDGES_SQL, coords, edges, query, r6, secs, sql
from witness.queries.corpus import _PLACES, NOTES_SQL, SCORED_SQL, _case, _notes
from witness.queries.evidence import AREA_SQL, AUTHOR_ORIGINS_SQL, GRADED, REPLAY_SQL, REPLAYED, areas, events, events_of, facts, facts_of
from witness.sources import drop_folder, feeds
from witness.streaming import streams

# ---------------------------------------------------------------- published reads

NOW = X.NOW
_FRAME = (174.69, -41.33, 174.73, -41.2)
_TOP = "topped AS (SELECT bubble_id FROM scored ORDER BY score DESC, last_seen DESC, bubble_id DESC LIMIT 500)"
_SHOWN = """shown AS (SELECT i.bubble_id, count(*) AS mass, count(DISTINCT origin_id) AS independent_sources, avg(lat) AS lat, avg(lng) AS lng, count(lat) AS n_geo FROM origins i JOIN topped USING (bubble_id) {where} GROUP BY 1)"""
_RADIUS = "radius AS (SELECT s.bubble_id, CASE WHEN any_value(n_geo) > 1 THEN round(max(" + geo.HAVERSINE_SQL.format(a="i.", b="s.") + "))::BIGINT END AS radius_m FROM shown s JOIN items i USING (bubble_id) {where} GROUP BY 1)"
_MAP = (BUBBLES_SQL, SCORED_SQL, _TOP, *GRADED, _SHOWN.format(where=""), _RADIUS.format(where=""))


def _grades(spark, items):
    return grade.graded(facts_of(spark, items), X.AS_AT).select("bubble_id", "reliability", "credibility")


def _top(spark, sf_dir, now):
    """Members of the bubbles that a map can show, in a table of their own: what follows reads no others."""
    return cut(reads.top_members(X.items(spark, sf_dir), now))


@query(sql(*_MAP, select=f"""SELECT bubble_id, mass, independent_sources, reliability || credibility AS grade, round(lat, 6) AS lat, round(lng, 6) AS lng, radius_m FROM shown JOIN (SELECT bubble_id, reliability, credibility FROM graded) g USING (bubble_id) JOIN radius USING (bubble_id)
WHERE credibility <= 4 AND lat IS NOT NULL AND lng BETWEEN {_FRAME[0]} AND {_FRAME[2]} AND lat BETWEEN {_FRAME[1]} AND {_FRAME[3]}"""))
def r1_map_layer(spark, sf_dir):
    items = _top(spark, sf_dir, NOW)
    placed, _ = reads.map_layer(items, origins.author_origins, _grades(spark, items), NOW, _FRAME, 4)
    return placed.select("bubble_id", "mass", "independent_sources", "grade", r6("lat"), r6("lng"), "radius_m")


@query(sql(*_MAP, select="SELECT bubble_id, mass, reliability || credibility AS grade FROM shown JOIN (SELECT bubble_id, reliability, credibility FROM graded) g USING (bubble_id) WHERE lat IS NULL"))
def r2_unmappable(spark, sf_dir):
    items = _top(spark, sf_dir, NOW)
    return reads.map_layer(items, origins.author_origins, _grades(spark, items), NOW)[1]


_KNOWN = "WHERE i.captured_at <= TIMESTAMP '2024-01-15 12:00:00'"
_SCORED_AT = SCORED_SQL.replace("TIMESTAMP '2024-02-01'", "TIMESTAMP '2024-01-15 12:00:00'")


@query(sql(BUBBLES_SQL, _SCORED_AT, _TOP, *GRADED, REPLAY_SQL, _SHOWN.format(where=_KNOWN), select="""SELECT s.bubble_id, s.mass, s.independent_sources, coalesce(t.g, g.reliability || g.credibility) AS grade FROM shown s JOIN graded g USING (bubble_id)
LEFT JOIN (SELECT bubble_id, arg_max(to_grade, (att, item_id)) AS g FROM transitions WHERE att <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1) t USING (bubble_id) WHERE s.lat IS NOT NULL"""))
def r3_scored_signal_as_at(spark, sf_dir):
    items = _top(spark, sf_dir, X.AS_AT)
    placed, _ = reads.map_layer(items, origins.author_origins, _grades(spark, items), X.AS_AT, None, as_at=X.AS_AT, events=events_of(spark, items))
    return placed.select("bubble_id", "mass", "independent_sources", "grade")


@query(sql(select="""SELECT bubble_id, round(any_value(c_lat), 6) AS lat, round(any_value(c_lng), 6) AS lng, CASE WHEN any_value(n) > 1 THEN round(max(""" + geo.HAVERSINE_SQL.format(a="", b="c_") + """))::BIGINT END AS radius_m
FROM (SELECT *, avg(lat) OVER w AS c_lat, avg(lng) OVER w AS c_lng, count(lat) OVER w AS n FROM items WINDOW w AS (PARTITION BY bubble_id)) GROUP BY 1"""))
def r4_locate(spark, sf_dir):
    return reads.located(X.items(spark, sf_dir)).select("bubble_id", r6("lat"), r6("lng"), "radius_m")


@query(sql(EDGES_SQL, select="SELECT floor(epoch(min(captured_at)))::BIGINT AS at_s FROM items JOIN edges ON from_id = item_id"))
def r5_capture_start(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return reads.capture_start(items.join(edges(items), F.col("from_id") == F.col("item_id"))).select(secs("captured_at").alias("at_s"))


_BIGGEST = "(SELECT bubble_id FROM items GROUP BY 1 ORDER BY count(*) DESC, bubble_id LIMIT 1)"


def _biggest(items):
    return items.groupBy("bubble_id").count().orderBy(F.desc("count"), "bubble_id").first().bubble_id


def _why(items):
    """Membership with the weight and reason of each decision."""
    return edges(items).withColumns({"weight": F.expr("1.0D / (1 + from_id % 7)"), "reason": F.expr("concat('decided on ', from_id % 7)")})


@query(sql(EDGES_SQL, AUTHOR_ORIGINS_SQL, select=f"""SELECT item_id, origin_id, source, author,
    CASE WHEN from_id IS NOT NULL THEN round(1.0::DOUBLE / (1 + item_id % 7), 6) END AS weight, CASE WHEN from_id IS NOT NULL THEN 'decided on ' || (item_id % 7) END AS reason
  FROM origins LEFT JOIN edges ON from_id = item_id WHERE bubble_id = {_BIGGEST}"""))
def r6_provenance(spark, sf_dir):
    items = X.items(spark, sf_dir)
    rows = reads.provenance(items, origins.author_origins, _biggest(items), edges=_why(items))
    return rows.select("item_id", "origin_id", "source", "author", r6("weight"), "reason")


@query(sql(AUTHOR_ORIGINS_SQL, select=f"""SELECT origin_id, list_sort(list(item_id))::VARCHAR AS items FROM origins WHERE bubble_id = {_BIGGEST}
  GROUP BY 1 HAVING count(*) > 1"""))
def r6_origin_sets(spark, sf_dir):
    items = X.items(spark, sf_dir)
    found = reads.origin_sets(reads.provenance(items, origins.author_origins, _biggest(items)))
    return found.select("origin_id", F.concat(F.lit("["), F.array_join(F.col("items").cast("array<string>"), ", "), F.lit("]")).alias("items"))


@query(sql(*REPLAYED, AUTHOR_ORIGINS_SQL, select=f"""SELECT count(*) AS items, count(DISTINCT origin_id) AS independent_sources,
    (SELECT count(*) FROM transitions WHERE bubble_id = {_BIGGEST})::INT AS n_history,
    (SELECT count(*) FROM (SELECT origin_id FROM origins WHERE bubble_id = {_BIGGEST} GROUP BY 1 HAVING count(*) > 1))::INT AS n_collapsed
  FROM origins WHERE bubble_id = {_BIGGEST}"""))
def r6_detail_counts(spark, sf_dir):
    found = r6_signal_detail(spark, sf_dir)
    return found.select("items", "independent_sources", F.size("history").alias("n_history"), F.size("origins").alias("n_collapsed"))


@query()
def r6_signal_detail(spark, sf_dir):
    items = X.items(spark, sf_dir)
    big = _biggest(items)
    own = items.where(F.col("bubble_id") == big)
    return reads.signal_detail(own, origins.author_origins, events_of(spark, own), big, edges=_why(items))


@query(sql(EDGES_SQL, COORD_SQL, select="SELECT i.item_id, c.x, e.to_id AS bubble FROM items i LEFT JOIN coords c USING (item_id) LEFT JOIN edges e ON e.from_id = i.item_id WHERE i.dataset_id = 'live' AND i.occurred_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY i.occurred_at, i.item_id LIMIT 2000"))
def r7_points(spark, sf_dir):
    from witness.operators import store

    items = X.items(spark, sf_dir)
    some = store.items_in_window(items, "2024-01-05", "2024-01-20", "live", 2000)
    return store.points(some, coords(items), edges(items)).select("item_id", "x", "bubble")


@query(sql(BUBBLES_SQL, SCORED_SQL, select="SELECT bubble_id, row_number() OVER (ORDER BY score DESC, last_seen DESC, bubble_id DESC)::INT AS rank, mass FROM scored WHERE last_seen >= TIMESTAMP '2024-01-20' AND first_seen <= TIMESTAMP '2024-01-31' ORDER BY rank LIMIT 500"))
def r8_board(spark, sf_dir):
    return reads.board(X.items(spark, sf_dir), NOW, "2024-01-20", "2024-01-31")


@query(sql(EDGES_SQL, NOTES_SQL, select=f"""SELECT item_id, source, '{{"item":' || item_id || '}}' AS payload,
    CASE WHEN from_id IS NOT NULL THEN 'decided on ' || (item_id % 7) END AS reason, coalesce(n.n, 0)::INT AS n_annotations
  FROM items LEFT JOIN edges ON from_id = item_id LEFT JOIN (SELECT node_id, count(*) AS n FROM notes GROUP BY 1) n ON node_id = item_id WHERE bubble_id = {_BIGGEST}"""))
def r9_bubble_detail(spark, sf_dir):
    items = X.items(spark, sf_dir)
    raw = items.withColumn("payload", F.to_json(F.struct(F.col("item_id").alias("item"))))
    found = reads.bubble_detail(raw, _notes(items), _biggest(items), _why(items))
    return found.select("item_id", "source", "payload", "reason", F.coalesce(F.size("annotations"), F.lit(0)).alias("n_annotations"))


_MAIN_HAZARD = """issues AS (SELECT bubble_id, hazard AS issue FROM (SELECT bubble_id, hazard, row_number() OVER (PARTITION BY bubble_id ORDER BY count(*) DESC, hazard) AS k
  FROM items GROUP BY 1, 2) WHERE k = 1)"""


@query(sql(*REPLAYED, _MAIN_HAZARD, select="""SELECT a.item_id, a.bubble_id, a.origins, a.items, issue, lat, lng FROM
  (SELECT item_id, bubble_id, origins::BIGINT AS origins, items FROM transitions WHERE alert_worthy AND att > TIMESTAMP '2024-01-15 12:00:00' ORDER BY att DESC, item_id DESC LIMIT 100) a
  LEFT JOIN issues USING (bubble_id) LEFT JOIN (SELECT bubble_id, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM items GROUP BY 1) USING (bubble_id)"""))
def c16_alerts_in_place(spark, sf_dir):
    items = X.items(spark, sf_dir)
    issues = fold.most_common(items, "bubble_id", "hazard").withColumnRenamed("hazard", "issue")
    found = reads.alerts_in_place(grade.alert_feed(events(spark, sf_dir), X.AS_AT), items, issues)
    return found.select("item_id", "bubble_id", "origins", "items", "issue", r6("lat"), r6("lng"))


_SPEED = "speeds AS (SELECT bubble_id, any_value(dataset_id) AS dataset_id, count(*) AS mass, max(occurred_at) AS last_seen, count(*) FILTER (occurred_at >= n - INTERVAL 1 HOUR) AS velocity FROM (SELECT *, max(occurred_at) OVER (PARTITION BY bubble_id) AS n FROM items) GROUP BY 1)"


def _speeds(items):
    return fold.fold_bubbles(items).join(fold.velocity(items), "bubble_id")


@query(sql(_SPEED, "quick AS (SELECT bubble_id, row_number() OVER (ORDER BY velocity DESC, mass DESC, bubble_id)::INT AS rank FROM speeds WHERE mass >= 2 AND velocity > 0 ORDER BY rank LIMIT 4)",
           select="SELECT 'picking up speed' AS lane, * FROM quick UNION ALL (SELECT 'most talked about', bubble_id, row_number() OVER (ORDER BY mass DESC, bubble_id)::INT AS rank FROM speeds WHERE mass >= 2 AND bubble_id NOT IN (SELECT bubble_id FROM quick) ORDER BY rank LIMIT 3)"))
def r10_lanes(spark, sf_dir):
    return reads.lanes(_speeds(X.items(spark, sf_dir)))


@query(sql(_SPEED, select="SELECT bubble_id, velocity FROM speeds WHERE mass >= 5"))
def j11_velocity_join(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return fold.fold_bubbles(items).where("mass >= 5").select("bubble_id").join(fold.velocity(items), "bubble_id", "left")


@query(sql(_SPEED, select="SELECT bubble_id, CASE WHEN mass < 2 THEN 'single' WHEN c - epoch_us(last_seen) <= 3600000000 AND velocity >= 2 THEN 'moving' WHEN c - epoch_us(last_seen) <= 3600000000 THEN 'building' ELSE 'quiet' END AS band FROM speeds, (SELECT epoch_us(max(last_seen)) AS c FROM speeds)"))
def r11_trend_bands(spark, sf_dir):
    return reads.trend_bands(_speeds(X.items(spark, sf_dir)))


@query(sql(AUTHOR_ORIGINS_SQL, select="""SELECT place, strftime(occurred_at, '%Y-%m-%d') AS day, CASE WHEN count(*) > 24 THEN round(100.0::DOUBLE * count(DISTINCT origin_id) / count(*))::INT END AS percent
  FROM origins GROUP BY 1, 2"""))
def r12_independence_meter(spark, sf_dir):
    o = origins.author_origins(X.items(spark, sf_dir)).withColumn("day", F.date_format("occurred_at", "yyyy-MM-dd"))
    n = o.groupBy("place", "day").agg(F.countDistinct("origin_id").alias("o"), F.count(F.lit(1)).alias("n"))
    return n.select("place", "day", reads.independence_meter(F.col("o"), F.col("n")).alias("percent"))


_NAMED = "named AS (SELECT bubble_id, CASE user_id % 15 % 3 WHEN 0 THEN 'north' ELSE 'south' END AS area FROM (SELECT bubble_id, min(user_id % 15) AS user_id FROM items GROUP BY 1) WHERE user_id % 15 % 2 = 0)"
_PLACED = "spots AS (SELECT b.bubble_id AS id, lng + 0.0013::DOUBLE AS lng, lat + 0.0017::DOUBLE AS lat, mass FROM bubbles b WHERE b.lat IS NOT NULL)"
_ZONE_IN = "zone_in AS (SELECT p.id, e.area FROM spots p JOIN area_edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lng < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


@query(sql(BUBBLES_SQL, AREA_SQL, _NAMED, _PLACED, _ZONE_IN, select="""SELECT area, mass, top_bubble, CASE WHEN mass >= greatest(8, max(mass) OVER () * 0.4) THEN 'hot' WHEN mass >= 5 THEN 'warm' ELSE 'mild' END AS heat FROM (
  SELECT area, sum(mass)::BIGINT AS mass, arg_max(id, (mass, id)) AS top_bubble FROM (SELECT id, mass, area FROM spots JOIN named ON bubble_id = id UNION ALL
    SELECT s.id, mass, min(z.area) AS area FROM spots s JOIN zone_in z USING (id) WHERE s.id NOT IN (SELECT bubble_id FROM named) GROUP BY 1, 2) GROUP BY 1 HAVING sum(mass) >= 2)"""))
def r13_impact_zones(spark, sf_dir):
    items = X.items(spark, sf_dir)
    b = fold.fold_bubbles(items).where("lat IS NOT NULL").selectExpr("bubble_id", "mass", "lng + 0.0013D AS lng", "lat + 0.0017D AS lat")
    named = items.groupBy("bubble_id").agg(F.min(F.col("user_id") % 15).alias("k")).where("k % 2 = 0").selectExpr("bubble_id", "CASE k % 3 WHEN 0 THEN 'north' ELSE 'south' END AS area")
    return reads.impact_zones(b, named, areas(spark))


@query(sql(select="SELECT item_id, upper(left(h, 1)) || substr(h, 2) AS hazard, upper(left(p, 1)) || substr(CASE WHEN length(p) > 24 THEN left(p, 23) || '…' ELSE p END, 2) AS place FROM (SELECT item_id, replace(CASE WHEN item_id % 5 = 0 THEN 'power_outage' ELSE hazard END, '_', ' ') AS h, CASE WHEN item_id % 3 = 0 THEN place || ' with a rather long name' ELSE place END AS p FROM items)"))
def r14_display_labels(spark, sf_dir):
    label = F.concat(F.expr("CASE WHEN item_id % 5 = 0 THEN 'power_outage' ELSE hazard END"), F.lit(" — "), F.expr("CASE WHEN item_id % 3 = 0 THEN concat(place, ' with a rather long name, Wellington') ELSE place END"))
    return X.items(spark, sf_dir).select("item_id", reads.display_label(label).alias("d")).select("item_id", "d.hazard", "d.place")


@query(sql(AUTHOR_ORIGINS_SQL, select="SELECT bubble_id, origin_id, count(*) AS items FROM origins GROUP BY 1, 2 HAVING count(*) > 1"))
def r15_collapsed(spark, sf_dir):
    return reads.collapsed(origins.author_origins(X.items(spark, sf_dir)))


@query(sql(AUTHOR_ORIGINS_SQL, select="SELECT bubble_id, CASE WHEN count(*) > count(DISTINCT origin_id) THEN count(*) - count(DISTINCT origin_id) END AS echoes FROM origins GROUP BY 1"))
def r16_amplification(spark, sf_dir):
    c = origins.origin_counts(origins.author_origins(X.items(spark, sf_dir)))
    return c.select("bubble_id", reads.amplification(F.col("items"), F.col("independent_sources")).alias("echoes"))


@query(sql(AUTHOR_ORIGINS_SQL, select="SELECT item_id, count(*) OVER (PARTITION BY origin_id) > 1 AS echo FROM origins"))
def r17_echoes(spark, sf_dir):
    return reads.echoes(origins.author_origins(X.items(spark, sf_dir)))


@query(sql(*GRADED[:2], REPLAY_SQL, select="SELECT bubble_id, arg_max(to_grade, (att, item_id)) AS to_grade FROM transitions WHERE alert_worthy GROUP BY 1"))
def r17_latest_alert(spark, sf_dir):
    return reads.latest_alert(events(spark, sf_dir))


# ---------------------------------------------------------------- adapter

_PAYLOAD = """CASE event_id % 4
  WHEN 0 THEN concat('{"source":"', event_type, '","timestamp":', unix_timestamp(CAST(ts AS TIMESTAMP)),
    ',"lat":', -41.3 + (user_id % 9) * 10, ',"lng":174.7,"title":"[Report] ', event_id, '.","text":"{value} ', value,
    '","k":"[k] ', event_id % 7, '","annotations":{"hazard":"h', user_id % 5, '"},"tags":{"sev":"', event_type, '"}}')
  WHEN 1 THEN concat('{"properties":{"feed":"f', user_id % 5, '","body":"seen ', event_id, '","level":"', event_type,
    '"},"geometry":{"type":"Point","coordinates":[174.8,-41.2]},"id":', event_id,
    ',"annotations":["free ', event_id % 3, '",{"key":"rank","value":', event_id % 11, '}],"tags":["a",', event_id % 5, ']}')
  WHEN 2 THEN concat('{"station":"{s', user_id % 6, '}","stage_m":', value, ',"latitude":-41.25,"synthetic":"', event_id % 8 = 2, '"}')
  ELSE CASE WHEN event_id % 3 = 0 THEN '[1,2]' WHEN event_id % 3 = 1 THEN '{"text":"  "}' ELSE concat('"bare report ', event_id, '"') END END"""


#: Payloads that one task reads: adapting takes about a millisecond each.
PAYLOADS = 20_000


def _payloads(spark, sf_dir):
    return X.dealt(X.read(spark, sf_dir, "events"), PAYLOADS).selectExpr("event_id", f"{_PAYLOAD} AS payload")


@query("""SELECT event_id, NOT (event_id % 4 = 3 AND event_id % 3 < 2) AS ok,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'f' || (user_id % 5) ELSE 'unknown' END AS source,
  CASE event_id % 4 WHEN 0 THEN '[Report] ' || event_id || ' — {value} ' || value WHEN 1 THEN 'seen ' || event_id WHEN 2 THEN 'station: {s' || (user_id % 6) || '}; stage m: ' || value
    ELSE CASE WHEN event_id % 3 = 2 THEN 'bare report ' || event_id END END AS text,
  CASE WHEN event_id % 4 = 0 AND abs(-41.3 + (user_id % 9) * 10) <= 90 THEN round((-41.3 + (user_id % 9) * 10)::DOUBLE, 6) WHEN event_id % 4 = 1 THEN -41.2::DOUBLE END AS lat,
  CASE WHEN event_id % 4 = 1 THEN event_id::VARCHAR END AS external_id, event_id % 8 = 2 AS synthetic, event_id % 4 <> 0 AS assumed_time FROM events""")
def a1_adapt(spark, sf_dir):
    a = A.adapt(_payloads(spark, sf_dir), NOW)
    return a.select("event_id", "ok", "source", "text", r6("lat"), "external_id", "synthetic", "assumed_time")


@query("""SELECT event_id, key, value FROM (
  SELECT event_id, 'k' AS key, '[k] ' || (event_id % 7) AS value FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT event_id, 'hazard', 'h' || (user_id % 5) FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT event_id, 'sev', event_type FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT event_id, 'annotation', 'free ' || (event_id % 3) FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT event_id, 'rank', (event_id % 11)::VARCHAR FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT event_id, 'tag', 'a' FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT event_id, 'tag', (event_id % 5)::VARCHAR FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT event_id, 'level', event_type FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT event_id, 'station', '{s' || (user_id % 6) || '}' FROM events WHERE event_id % 4 = 2
  UNION ALL SELECT event_id, 'stage_m', value::VARCHAR FROM events WHERE event_id % 4 = 2
  UNION ALL SELECT event_id, 'synthetic', 'true' FROM events WHERE event_id % 8 = 2
  UNION ALL SELECT event_id, 'assumed_occurred_at', 'true' FROM events WHERE event_id % 4 IN (1, 2) OR (event_id % 4 = 3 AND event_id % 3 = 2))""")
def a11_annotations(spark, sf_dir):
    a = A.annotations(A.adapt(_payloads(spark, sf_dir), NOW), "event_id")
    return a.where("key <> 'geo_dropped'").select(F.col("node_id").alias("event_id"), "key", "value")


@query("""SELECT doc_id, CASE WHEN length(t) > 4000 THEN left(t, 4000) || '…' ELSE t END AS text, true AS told
  FROM (SELECT doc_id, trim('ab\\u0000 ' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', '', 'g')) AS t FROM documents)""")
def a2_strip_nul(spark, sf_dir):
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 .,]", "")
    d = X.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('{"text":"a\\u0000b\\\\u0000 '), plain, F.lit('"}')).alias("payload"))
    return A.adapt(d, NOW).select("doc_id", "text", F.exists("annotations", lambda a: a["key"] == "nul_bytes_stripped").alias("told"))


_VALUES = "['true', 'FALSE', '1', '0', 'maybe', '', ' True ']"


@query(f"SELECT event_id, CASE WHEN lower(trim(v)) IN ('true', '1') THEN true WHEN lower(trim(v)) IN ('false', '0') THEN false END AS b FROM (SELECT event_id, {_VALUES}[event_id % 7 + 1] AS v FROM events)")
def a5_boolean(spark, sf_dir):
    v = F.expr("element_at(array" + _VALUES.replace("[", "(").replace("]", ")") + ", CAST(event_id % 7 + 1 AS INT))")
    return X.read(spark, sf_dir, "events").select("event_id", A.boolean_of(v).alias("b"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN floor(epoch(ts))::BIGINT WHEN 1 THEN floor(epoch(ts))::BIGINT END AS s FROM events")
def a7_instant(spark, sf_dir):
    e = X.read(spark, sf_dir, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    v = F.when(F.col("event_id") % 3 == 0, F.col("s").cast("string")).when(F.col("event_id") % 3 == 1, (F.col("s") * 1000 + 7).cast("string")).otherwise((F.col("event_id") % 1000).cast("string"))
    return e.select("event_id", F.unix_seconds(A.instant_of(v)).alias("s"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 AND -41.3 + (user_id % 9) * 10 <= 90 THEN 'placed' WHEN event_id % 4 = 1 THEN 'placed' WHEN event_id % 4 = 3 THEN 'none' ELSE 'dropped' END AS geo FROM events")
def a8_geo(spark, sf_dir):
    a = A.adapt(_payloads(spark, sf_dir), NOW)
    return a.select("event_id", F.when(F.col("lat").isNotNull(), "placed").when(F.col("geo_dropped").isNotNull(), "dropped").otherwise("none").alias("geo"))


@query("SELECT doc_id, length(coalesce(text, '')) > 4000 AS cut, CASE WHEN length(coalesce(text, '')) > 4000 THEN 4001 ELSE length(coalesce(text, '')) END AS n FROM documents")
def a10_truncate(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return X.read(spark, sf_dir, "documents").select("doc_id", (F.length(t) > A.MAX_TEXT).alias("cut"), F.length(A.shorten(t, A.MAX_TEXT)).cast("long").alias("n"))


# ---------------------------------------------------------------- sources


@query()
def s1_drop_folder(spark, sf_dir):
    """Files of several items each, made of the events of an hour; every seventh is broken."""
    e = _payloads(spark, sf_dir)
    files = e.groupBy(F.floor(F.col("event_id") / 40).alias("f")).agg(F.sort_array(F.collect_list(F.struct("event_id", "payload"))).alias("p"))
    body = F.array_join(F.transform("p", lambda p: p["payload"]), ",")
    made = files.select(F.concat(F.lit("file"), F.col("f").cast("string")).alias("path"), F.when(F.col("f") % 7 == 3, F.concat(F.lit("{"), body)).when(F.col("f") % 7 == 4, F.concat(F.lit('{"items":['), body, F.lit("]}"))).otherwise(F.concat(F.lit("["), body, F.lit("]"))).alias("value"))
    read = drop_folder.items_of_files(made)
    told = A.adapt(read, NOW).withColumn("verdict", F.when(F.col("ok"), "created").otherwise("failed"))
    return drop_folder.route_files(told)


@query(sql(select="SELECT source, source_class, count(*) AS n FROM items GROUP BY 1, 2"))
def s4_envelope_counts(spark, sf_dir):
    return drop_folder.envelope_counts(X.items(spark, sf_dir))


def _quake_features(spark, sf_dir):
    return X.dealt(X.items(spark, sf_dir), 50_000).selectExpr("item_id", """concat('{"geometry":{"coordinates":[', 174.7 + (user_id % 40) * 0.01, ',', -41.35 + (user_id % 30) * 0.01, ']},"properties":{"publicID":"q', item_id, '","time":"', date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","magnitude":', round(value / 20, 2), ',"depth":', value, ',"mmi":', CAST(value AS INT) % 10, ',"count":', item_id % 4, ',"locality":"near ', place, '","quality":"', CASE WHEN item_id % 9 = 0 THEN 'deleted' ELSE 'best' END, '"}}') AS feature""")


_QUAKES_SQL = "quakes AS (SELECT *, 174.7::DOUBLE + (user_id % 40) * 0.01::DOUBLE AS q_lng, -41.35::DOUBLE + (user_id % 30) * 0.01::DOUBLE AS q_lat, 174.7762::DOUBLE AS c_lng, -41.2865::DOUBLE AS c_lat FROM items)"


@query(sql(_QUAKES_SQL, select="""SELECT 'geonet-quake:q' || item_id AS record_id, 'Magnitude ' || round(round((value / 20)::VARCHAR::DECIMAL(20, 17), 2), 1)::DECIMAL(9, 1) || ' earthquake near ' || place || ', ' || round(value::DECIMAL(18, 9))::BIGINT
    || ' km deep. Estimated shaking intensity MMI ' || floor(value)::INT % 10 || '. Epicentre approximately ' || printf('%.0f', """ + geo.HAVERSINE_SQL.format(a="q_", b="c_") + """ / 1000) || ' km from Wellington.' AS text,
    date_trunc('second', occurred_at) AS observed_at, round(q_lat, 6) AS lat, round(q_lng, 6) AS lng
  FROM quakes WHERE item_id % 9 <> 0 AND date_trunc('second', occurred_at) >= TIMESTAMP '2024-01-20'"""))
def s5_quakes(spark, sf_dir):
    return feeds.quakes(_quake_features(spark, sf_dir), "2024-01-30 00:00:00", 240).select("record_id", "text", "observed_at", r6("lat"), r6("lng"))


@query(sql(select="""SELECT printf('%.3f,%.3f', round(174.7 + (user_id % 40) * 0.01, 3), round(-41.35 + (user_id % 30) * 0.01, 3)) AS cell, CASE WHEN m <= 2 THEN 'unnoticeable' WHEN m = 3 THEN 'weak, felt indoors' WHEN m = 4 THEN 'light, felt by many indoors' WHEN m = 5 THEN 'moderate, felt by nearly everyone' WHEN m = 6 THEN 'strong, some damage possible' WHEN m = 7 THEN 'severe, damage likely' ELSE 'extreme' END AS band, count(*) AS n
FROM (SELECT *, floor(value)::INT % 10 AS m FROM items) WHERE (174.7 + (user_id % 40) * 0.01) BETWEEN 174.62 AND 174.94 AND (-41.35 + (user_id % 30) * 0.01) BETWEEN -41.36 AND -41.14 GROUP BY 1, 2"""))
def s6_felt_bands(spark, sf_dir):
    f = feeds.felt_reports(_quake_features(spark, sf_dir), NOW)
    rows = f.select(F.substring("external_id", 6, 100).alias("cell"), F.regexp_extract("text", r"MMI \d+ \((.*)\)\.", 1).alias("band"))
    return rows.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("n"))


def _escaped(texts):
    """Adds the whole text as a JSON string, and as HTML in XML without the characters that XML can't hold."""
    json = F.to_json(F.array("text"))
    html = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&amp;lt;"))
    bare = F.regexp_replace(html, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " ")
    return texts.withColumns({"json_text": F.substring(json, F.lit(2), F.length(json) - 2), "xml_text": bare})


@query(X.with_sql(X.TEXTS_SQL, select="""SELECT 'metservice:w' || doc_id AS record_id, left('Heavy rain watch — area ' || (doc_id % 9) || ' — ' || text, 2000) AS text, -41.325::DOUBLE AS lat, 174.75::DOUBLE AS lng, 'other' AS hazard
  FROM texts"""))
def s7_cap_features(spark, sf_dir):
    d = _escaped(X.texts(spark, sf_dir)).selectExpr("""concat('{"geometry":{"type":"Polygon","coordinates":[[[174.6,-41.4],[174.9,-41.4],[174.9,-41.1],[174.6,-41.4]]]},"properties":{"identifier":"w', doc_id, '","info_headline":"Heavy rain watch","info_event":"rain","info_area_areaDesc":"area ', doc_id % 9, '","info_description":', json_text, ',"sent":"2024-01-05T00:00:00Z"}}') AS feature""")
    return feeds.cap_features(d, NOW).select("record_id", "text", r6("lat"), r6("lng"), "hazard")


@query(sql(select="""SELECT item_id::VARCHAR AS external_id, 'Blockage Pringle Street · waste water' AS text, CASE WHEN item_id % 2 = 0 THEN 'official_crowd' ELSE 'official' END AS source_kind, 'water' AS hazard,
    date_trunc('milliseconds', occurred_at) AS observed_at FROM items WHERE lng BETWEEN 174.62 AND 174.94 AND lat BETWEEN -41.36 AND -41.14"""))
def s8_water_faults(spark, sf_dir):
    f = X.dealt(X.items(spark, sf_dir), 50_000).where("lat IS NOT NULL").selectExpr("""concat('{"geometry":{"coordinates":[', lng, ',', lat, ']},"properties":{"OBJECTID":', item_id, ',"description":"Blockage ', user_id, ' Pringle Street","watertype":"waste water","custservrequestcheck":"', CASE WHEN item_id % 2 = 0 THEN 'Customer Service Request' ELSE 'no' END, '","reportdate":', unix_millis(occurred_at), '}}') AS feature""")
    return feeds.water_faults(f, NOW).select("external_id", "text", "source_kind", "hazard", "observed_at")


_PLACE_OF = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b{p}\\b') THEN '{p}'" for p in _PLACES) + " END"


@query(X.with_sql(X.TEXTS_SQL, select=f"""SELECT 'bluesky:at://did/app/' || doc_id AS record_id, ['photo', 'video', 'link', 'none'][doc_id % 4 + 1] AS media, 'https://bsky.app/profile/H' || (doc_id % 50) || '/post/' || doc_id AS url,
    array_to_string(list_append(list_filter(u, lambda x, i: list_position(u, x) = i), 'https://ex.org/a/' || (doc_id % 9)), '|') AS quoted_urls, 'anon-' || left(sha256('{X.SALT}:h' || (doc_id % 50)), 12) AS author,
    {_case(T.HAZARD_RULES)} ELSE 'other' END AS hazard, {_PLACE_OF} AS location_text
  FROM (SELECT *, regexp_extract_all(text, 'https?://[^\\s<>\"'')]+') AS u FROM texts)"""))
def s9_bluesky(spark, sf_dir):
    p = _escaped(X.texts(spark, sf_dir)).selectExpr("""concat('{"uri":"at://did/app/', doc_id, '","author":{"handle":"H', doc_id % 50, '"},"record":{"text":', json_text, ',"createdAt":"2024-01-05T00:00:00Z"},"embed":{"$type":"app.bsky.embed.', element_at(array('images', 'video', 'external', 'x'), CAST(doc_id % 4 + 1 AS INT)), '","external":{"uri":"https://ex.org/a/', doc_id % 9, '"}}}') AS post""")
    found = feeds.bluesky_posts(p, NOW, X.SALT)
    return found.select("record_id", "media", "url", F.array_join("quoted_urls", "|").alias("quoted_urls"), "author", "hazard", "location_text")


def _atom(spark, sf_dir):
    return _escaped(X.texts(spark, sf_dir)).selectExpr("doc_id", """concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Report ', doc_id, '</title><id>t', doc_id, '</id><updated>2024-01-05T00:00:00+00:00</updated><link href="https://ex.org/', doc_id, '"/><author><name>u', doc_id % 60, '</name></author><content>&lt;p&gt;', CASE WHEN doc_id % 5 = 0 THEN 'submitted by someone' ELSE xml_text END, '&lt;/p&gt;</content></entry></feed>') AS xml""")


@query()
def s10_atom(spark, sf_dir):
    return feeds.atom_posts(_atom(spark, sf_dir), NOW, "Wellington", X.SALT).select("record_id", "text", "author", "url", "media", "observed_at")


def _harvested(spark, sf_dir):
    docs = _atom(spark, sf_dir).selectExpr("concat('feed', doc_id % 6) AS source_id", "'social' AS tier", "'pub' AS publisher", "xml AS body")
    return feeds.harvest(docs, "atom")


@query()
def s11_harvest(spark, sf_dir):
    return _harvested(spark, sf_dir).select("id", "published_at", "title", "author", "independence_key", "fingerprint", "hint_places", "hint_impacts")


@query(sql(select="SELECT s.source AS source_id, coalesce(n, 0) AS rows, coalesce(h, 0) AS hits, coalesce(n, 0) = 0 AS warned FROM (SELECT DISTINCT source FROM items) s LEFT JOIN (SELECT source, count(*) AS n, count(*) FILTER (event_type = 'click') AS h FROM items WHERE source <> 'src5' GROUP BY 1) USING (source)"))
def s12_harvest_report(spark, sf_dir):
    items = X.items(spark, sf_dir)
    some = F.array(F.lit("x"))
    r = items.where("source <> 'src5'").select(F.col("source").alias("source_id"), some.alias("hint_places"), F.when(F.col("source_class") == "click", some).otherwise(F.array().cast("array<string>")).alias("hint_impacts"))
    return feeds.harvest_report(r, items.select(F.col("source").alias("source_id")).distinct())


def _cap(spark, sf_dir):
    return X.items(spark, sf_dir).selectExpr("""concat('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>c', item_id % 700, '</identifier><sent>2024-01-05</sent><info><event>', hazard, '</event><headline>h</headline><severity>', event_type, '</severity><onset>o', item_id % 3, '</onset><area><areaDesc>', CASE WHEN item_id % 4 = 0 THEN 'Wellington' ELSE 'Otago' END, '</areaDesc><polygon>1,2 3,4 5,6</polygon></area></info><info><event>second</event></info></alert>') AS xml""", "concat('u', item_id) AS url")


@query(sql(select="""SELECT 'c' || (item_id % 700) AS identifier, e AS event, CASE WHEN k = 1 THEN event_type END AS severity, CASE WHEN k = 1 THEN CASE WHEN item_id % 4 = 0 THEN 'Wellington' ELSE 'Otago' END ELSE '' END AS area,
    CASE WHEN k = 1 THEN 3 ELSE 0 END AS polygon_points, k = 1 AND item_id % 4 = 0 AS relevant
  FROM (SELECT *, unnest([1, 2]) AS k, unnest([hazard, 'second']) AS e FROM items)"""))
def s13_cap_history(spark, sf_dir):
    return feeds.cap_history(_cap(spark, sf_dir)).select("identifier", "event", "severity", "area", "polygon_points", "relevant")


@query("""SELECT doc_id AS post_id, left(CASE WHEN title <> '' AND coalesce(text, '') <> '' THEN title || ' — ' || text WHEN title <> '' THEN title ELSE text END, 4000) AS text, platform || '-' || lang AS source, CASE WHEN platform = 'news' THEN 'media' ELSE 'social' END AS source_class
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'news' ELSE 'reddit' END AS platform, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE '' END AS title FROM documents)
WHERE trim(coalesce(text, title)) <> '' AND doc_id % 1000 >= 100""")
def s14_load_feeds(spark, sf_dir):
    posts = X.read(spark, sf_dir, "documents").selectExpr("doc_id AS post_id", "CASE WHEN doc_id % 3 = 0 THEN 'news' ELSE 'reddit' END AS platform", "lang AS feed", "CASE WHEN doc_id % 2 = 0 THEN concat('T', doc_id) ELSE '' END AS title", "text", "timestamp_seconds(doc_id % 1000) AS posted_at", "'a' AS author", "'u' AS url")
    return feeds.load_feeds(posts, "1970-01-01 00:01:40").select("post_id", "text", "source", "source_class")


@query(sql(select="""SELECT item_id::VARCHAR AS record_id, CASE source_class WHEN 'click' THEN 'media' WHEN 'view' THEN 'official_feed' WHEN 'error' THEN 'error' ELSE 'social' END AS source_class, 2 + (item_id % 2 = 0 OR item_id % 5 = 0)::INT + (item_id % 7 = 0)::INT + (item_id % 3)::INT AS n_annotations,
  CASE WHEN item_id % 7 = 0 THEN 'https://ex.org/i/' || item_id END AS image, CASE WHEN item_id % 5 = 0 THEN 'matched' WHEN item_id % 2 = 0 THEN hazard END AS place FROM items"""))
def s17_upload_items(spark, sf_dir):
    r = X.items(spark, sf_dir).selectExpr("string(item_id) AS record_id", "source", "CASE source_class WHEN 'click' THEN 'news' WHEN 'view' THEN 'official' WHEN 'error' THEN 'error' ELSE 'social' END AS source_kind", "'t' AS text", "false AS text_generated", "occurred_at AS observed_at", "lat", "lng", "geo_confidence AS confidence", "external_id", "author",
                                          "string(null) AS url", "array() AS quoted_urls", "CASE WHEN item_id % 2 = 0 THEN hazard END AS location_text", "CASE WHEN item_id % 5 = 0 THEN 'matched' END AS matched_place", "CASE WHEN item_id % 7 = 0 THEN concat('https://ex.org/i/', item_id) END AS media_url", "string(null) AS method", "array_repeat('l', CAST(item_id % 3 AS INT)) AS limitations")
    said = lambda key, name: F.get(F.filter("annotations", lambda a: a["key"] == key), F.lit(0))["value"].alias(name)
    found = feeds.to_upload_items(r, "live")
    return found.select("record_id", "source_class", F.size("annotations").alias("n_annotations"), said("image_url", "image"), said("location_text", "place"))


@query(sql(select="""SELECT item_id, floor(t / 1000000)::BIGINT AS at_s, floor(greatest(t, least(t + lag, e - 30000000)) / 1000000)::BIGINT AS heard_s FROM (SELECT item_id, epoch_us(occurred_at) + e - 300000000 - (SELECT epoch_us(max(occurred_at)) FROM items) AS t, (3 + (item_id * 7) % 6) * 60000000 AS lag, e FROM items, (SELECT epoch_us(TIMESTAMP '2024-02-01') AS e))"""))
def s18_slide_times(spark, sf_dir):
    s = feeds.slide_times(X.items(spark, sf_dir).drop("captured_at").withColumn("pos", F.col("item_id")), NOW)
    return s.select("item_id", secs("occurred_at").alias("at_s"), secs("captured_at").alias("heard_s"))


# ---------------------------------------------------------------- features, gauges, weather


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type)), 'brand#3') AND p_size % 2 = 0")
def l6_search_catalogue(spark, sf_dir):
    c = X.read(spark, sf_dir, "part").selectExpr("p_partkey", "string(p_partkey) AS id", "p_name AS title", "p_brand AS layer", "p_type AS theme", "'' AS description", "'' AS provider", "p_size % 2 = 0 AS queryable")
    return weather.search_catalogue(c, text="brand#3", queryable=True).select("p_partkey")


@query(sql(select="""SELECT 'g' || (user_id % 3) AS site, floor(epoch(occurred_at))::BIGINT AS at_s, CASE WHEN item_id % 50 <> 0 THEN value END AS value,
    item_id % 50 = 0 AS gap, 'mm' AS units FROM items"""))
def l7_gauge_readings(spark, sf_dir):
    x = X.items(spark, sf_dir).selectExpr("""concat('<Hilltop><Measurement SiteName="g', user_id % 3, '"><DataSource><ItemInfo ItemNumber="1"><ItemName>Flow</ItemName><Units>m3/s</Units></ItemInfo><ItemInfo ItemNumber="2"><ItemName>Stage</ItemName><Units>mm</Units></ItemInfo></DataSource><Data><E><T>', date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss"), '</T><I1>1</I1><I2>', CASE WHEN item_id % 50 = 0 THEN 'gap' ELSE string(value) END, '</I2></E></Data></Measurement></Hilltop>') AS xml""")
    return weather.gauge_readings(x, "stage").select("site", secs("at").alias("at_s"), "value", (F.col("text") == "gap").alias("gap"), "units")


@query(sql(select="SELECT 'g' || (user_id % 3) AS site, floor(epoch(max(occurred_at)))::BIGINT AS latest_s, max(occurred_at) < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 1 HOUR AS stale FROM (SELECT user_id, occurred_at - INTERVAL (CASE WHEN user_id % 3 = 1 THEN 50 ELSE 0 END) HOUR AS occurred_at FROM items) GROUP BY 1"))
def l8_stale_gauges(spark, sf_dir):
    r = X.items(spark, sf_dir).selectExpr("concat('g', user_id % 3) AS site", "CASE WHEN user_id % 3 = 1 THEN occurred_at - INTERVAL 50 HOURS ELSE occurred_at END AS at")
    return weather.stale_gauges(r, "2024-01-30 23:00:00", 1.0).select("site", secs("latest").alias("latest_s"), "stale")


_RAIN = "rain AS (SELECT strftime(occurred_at, '%Y-%m-%d') AS day, 'g' || (user_id % 3) AS gauge, round(sum(CASE WHEN day(occurred_at) % 3 = 0 THEN value ELSE 0 END), 6) AS mm FROM items GROUP BY 1, 2), peaks AS (SELECT strftime(occurred_at, '%Y-%m-%d') AS day, max(value) AS river_peak FROM items WHERE event_type = 'error' AND value > 99 GROUP BY 1)"


@query(sql(_RAIN, select="""SELECT d.day, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2, river_peak, river_peak IS NOT NULL AS corroborated_by_river FROM (SELECT day, sum(mm) FILTER (gauge = 'g0') AS g0, sum(mm) FILTER (gauge = 'g1') AS g1, sum(mm) FILTER (gauge = 'g2') AS g2 FROM rain GROUP BY 1) d LEFT JOIN peaks USING (day)
WHERE greatest(coalesce(g0, 0), coalesce(g1, 0), coalesce(g2, 0)) >= 25"""))
def l9_extreme_rain_days(spark, sf_dir):
    items = X.items(spark, sf_dir)
    day = F.date_format("occurred_at", "yyyy-MM-dd").alias("day")
    fell = F.expr("CASE WHEN day(occurred_at) % 3 = 0 THEN value ELSE 0 END AS value")
    rain = items.select(day, F.expr("concat('g', user_id % 3) AS gauge"), fell).groupBy("day", "gauge").agg(F.round(F.sum("value"), 6).alias("mm"))
    peaks = items.where("event_type = 'error' AND value > 99").groupBy(day).agg(F.max("value").alias("river_peak"))
    d = weather.extreme_rain_days(rain, peaks, ["g0", "g1", "g2"])
    return d.select("day", r6("g0"), r6("g1"), r6("g2"), "river_peak", "corroborated_by_river")


@query(sql(select="SELECT event, severity, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY identifier, area, onset ORDER BY snapshot, warning_id) AS k FROM (SELECT item_id AS warning_id, 'w' || (item_id % 700) AS identifier, place AS area, CASE WHEN item_id % 3 = 0 THEN 'o' END AS onset, occurred_at AS snapshot, hazard AS event, event_type AS severity FROM items)) WHERE k = 1 GROUP BY 1, 2"))
def l10_unique_warnings(spark, sf_dir):
    w = X.items(spark, sf_dir).selectExpr("item_id AS warning_id", "concat('w', item_id % 700) AS identifier", "place AS area", "CASE WHEN item_id % 3 = 0 THEN 'o' END AS onset", "occurred_at AS snapshot", "hazard AS event", "event_type AS severity")
    return weather.warning_counts(weather.unique_warnings(w))


@query(sql(select="SELECT day, count(*) AS mentions FROM (SELECT url, min(day) AS day FROM (SELECT CASE WHEN item_id % 5 <> 0 THEN 'u' || (item_id % 1500) END AS url, strftime(occurred_at, '%Y-%m-%d') AS day FROM items) WHERE url IS NOT NULL GROUP BY 1) GROUP BY 1 HAVING count(*) >= 3"))
def l11_likely_warning_days(spark, sf_dir):
    m = X.items(spark, sf_dir).selectExpr("CASE WHEN item_id % 5 <> 0 THEN concat('u', item_id % 1500) END AS url", "date_format(occurred_at, 'yyyy-MM-dd') AS day")
    return weather.likely_warning_days(m)


@query(sql(select="SELECT item_id, round((-41.35 + (user_id % 30) * 0.01)::DOUBLE, 6) AS lat, round((174.7 + (user_id % 40) * 0.01)::DOUBLE, 6) AS lng FROM items"))
def l3_flat_rows(spark, sf_dir):
    f = _quake_features(spark, sf_dir)
    return spatial.flat_rows(f).select("item_id", r6("lat"), r6("lng"))


@query(sql(select="SELECT item_id, round((lng + 174.9 + 174.8) / 3, 6) AS lng, round((lat - 41.1 - 41.3) / 3, 6) AS lat, round(lng, 6) AS first_lng FROM items WHERE lat IS NOT NULL"))
def v8_vertex_mean(spark, sf_dir):
    ring = F.concat(F.lit("[[["), F.col("lng").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("],[174.9,-41.1],[174.8,-41.3]]]"))
    rows = X.items(spark, sf_dir).where("lat IS NOT NULL").select("item_id", spatial.vertex_mean(ring).alias("m"), spatial.first_vertex(ring).alias("f"))
    return rows.select("item_id", r6("m.lng", "lng"), r6("m.lat", "lat"), r6("f.lng", "first_lng"))


@query()
def v3_dense_embedding(spark, sf_dir):
    """The blended embedding of every document, as its cosine with the first axis of the background."""
    sparse = V.sparse_vectors(X.dealt(X.read(spark, sf_dir, "documents")), "doc_id", "text")
    base = F.array(*(F.lit(x) for x in V.background()))
    return V.dense_embedding(sparse, "doc_id").select("doc_id", r6(V.cosine(F.col("embedding"), base), "cosine"))


@query("SELECT doc_id AS node_id, 'embedding_model' AS key, 'lexical' AS value, 'rule' AS annotator FROM documents WHERE regexp_matches(coalesce(text, ''), '[A-Za-z0-9]')")
def v3_embedder_notes(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents").where(F.coalesce("text", F.lit("")).rlike("[A-Za-z0-9]"))
    return V.embedder_notes(docs, "doc_id", "lexical")


# ---------------------------------------------------------------- batch twins of streams


@query(sql(select="SELECT dataset_id, floor(epoch(time_bucket(INTERVAL 1 HOUR, occurred_at)))::BIGINT AS start_s, count(*) AS n FROM items GROUP BY 1, 2"))
def w7_tumbling_counts(spark, sf_dir):
    return streams.tumbling_counts(X.items(spark, sf_dir)).select("dataset_id", secs("start").alias("start_s"), "n")


@query(sql(EDGES_SQL, select="SELECT item_id FROM items WHERE item_id NOT IN (SELECT from_id FROM edges)"))
def w6_sweep(spark, sf_dir):
    items = X.items(spark, sf_dir)
    return streams.sweep(items, edges(items)).select("item_id")
