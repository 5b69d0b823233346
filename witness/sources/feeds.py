"""Raw feeds, as tables of fetched bodies or features, to records and items.

``features`` functions take one JSON feature per row (column ``feature``); ``xml`` functions one document per row.
``now`` stands for the time of collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witness import model
from witness.functions import text as T
from witness.functions.geo import haversine_m, in_frame
from witness.operators.spatial import vertex_mean

RECORD = ("record_id", "source_kind", "source", "external_id", "text", "text_generated", "observed_at", "lat", "lng", "confidence", "method", "location_text", "hazard", "media", "url", "quoted_urls", "author", "limitations")
#: Kinds as the classes that items carry.
KIND_CLASS = {"official": "official_feed", "official_crowd": "community_report", "news": "media", "social": "social"}


def _get(path: str, column: str = "feature") -> Column:
    return F.get_json_object(column, path)


def _record(df: DataFrame, **cols: Column) -> DataFrame:
    kinds = {"text_generated": "boolean", "observed_at": "timestamp", "lat": "double", "lng": "double", "confidence": "double", "quoted_urls": "array<string>", "limitations": "array<string>"}
    return df.select(*(cols.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RECORD))


def _array(*xs: Column | str) -> Column:
    return F.array_compact(F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs)))


# The published sentences, limitation texts, record names and addresses in the functions from here to
# ``atom_posts``, each beside the fields that it is put together from.


def quakes(features: DataFrame, now: str, hours: float = 72, radius_km: float = 250.0) -> DataFrame:
    """Quakes with an id, in WGS84, within the window and radius, not retracted; the sentence is composed."""
    lng, lat = _get("$.geometry.coordinates[0]").try_cast("double"), _get("$.geometry.coordinates[1]").try_cast("double")
    west = haversine_m(lat, lng, F.lit(model.CBD[1]), F.lit(model.CBD[0])) / 1000
    at = F.coalesce(T.instant(_get("$.properties.time")), F.lit(now).cast("timestamp"))
    ident, quality = _get("$.properties.publicID"), _get("$.properties.quality")
    kept = features.where(
        ident.isNotNull() & lng.between(-180, 180) & lat.between(-90, 90) & (west <= radius_km) & (F.coalesce(quality, F.lit("")) != "deleted")
        & (F.unix_micros(at) >= F.unix_micros(F.lit(now).cast("timestamp")) - int(hours * 3.6e9))
    )
    mag, depth = F.coalesce(_get("$.properties.magnitude").try_cast("double"), F.lit(0.0)), F.coalesce(_get("$.properties.depth").try_cast("double"), F.lit(0.0))
    place = F.coalesce(_get("$.properties.locality"), F.lit("unknown location"))
    text = F.format_string("Magnitude %.1f earthquake %s, %.0f km deep. Estimated shaking intensity MMI %s. Epicentre approximately %.0f km from Wellington.", mag, place, depth, F.coalesce(_get("$.properties.mmi"), F.lit("unknown")), west)
    return _record(kept, record_id=F.concat(F.lit("geonet-quake:"), ident), source_kind=F.lit("official"), source=F.lit("geonet-quakes"), external_id=ident, text=text, text_generated=F.lit(True), observed_at=at,
                   lat=lat, lng=lng, confidence=F.lit(0.9), method=F.lit("exact"), location_text=place, hazard=F.lit("earthquake"), media=F.lit("link"), url=F.concat(F.lit("https://www.geonet.org.nz/earthquake/"), ident),
                   quoted_urls=F.array().cast("array<string>"), limitations=_array(F.concat(F.lit("Instrument-measured by GeoNet. Solution quality: "), F.coalesce(quality, F.lit("unknown")), F.lit(".")), "The plotted point is the epicentre — impacts occur elsewhere, and shaking is felt well beyond it.",
                   "Magnitude and depth are automatic estimates and may be revised.", "Description text is composed from GeoNet's structured fields, not written by a person."))


def intensity_words(mmi: Column) -> Column:
    """2 or less, exactly 3 to 7, anything else: the published bands."""
    # Fixed values.
    words = {3: "weak, felt indoors", 4: "light, felt by many indoors", 5: "moderate, felt by nearly everyone", 6: "strong, some damage possible", 7: "severe, damage likely"}
    found = F.when(mmi <= 2, "unnoticeable")
    for k, w in words.items():
        found = found.when(mmi == k, w)
    return found.otherwise("extreme")


def cell_id(lng: Column, lat: Column) -> Column:
    return F.format_string("%.3f,%.3f", lng, lat)


def felt_reports(features: DataFrame, now: str, quake: str | None = None, frame: tuple | None = model.CITY_FRAME) -> DataFrame:
    """Felt-report cells in the frame; the cell is the stable id."""
    lng, lat = _get("$.geometry.coordinates[0]").try_cast("double"), _get("$.geometry.coordinates[1]").try_cast("double")
    kept = features.where(lng.between(-180, 180) & lat.between(-90, 90))
    kept = kept.where(in_frame(lat, lng, frame)) if frame else kept
    mmi, n = F.coalesce(_get("$.properties.mmi").try_cast("double"), F.lit(0.0)), F.coalesce(_get("$.properties.count").try_cast("int"), F.lit(1))
    ident = F.concat(F.lit(f"{quake}:" if quake else "felt:"), cell_id(lng, lat))
    shown = F.regexp_replace(mmi.cast("string"), r"\.0$", "")
    text = F.concat(n.cast("string"), F.lit(" public report"), F.when(n == 1, "").otherwise("s"), F.lit(" of feeling earthquake shaking here. Reported intensity MMI "), shown, F.lit(" ("), intensity_words(mmi), F.lit(")."))
    return _record(kept, record_id=F.concat(F.lit("geonet-felt:"), ident), source_kind=F.lit("official_crowd"), source=F.lit("geonet-felt-reports"), external_id=ident, text=text, text_generated=F.lit(True),
                   observed_at=F.lit(now), lat=lat, lng=lng, confidence=F.lit(0.7), method=F.lit("exact"), hazard=F.lit("earthquake"), media=F.lit("none"),
                   url=F.lit(f"https://www.geonet.org.nz/earthquake/{quake}" if quake else None), quoted_urls=F.array().cast("array<string>"),
                   limitations=_array("Public 'felt it' reports collected by GeoNet — unverified individual observations, officially aggregated."))


def cap_features(features: DataFrame, now: str) -> DataFrame:
    """Warnings: headline — area — description, placed at the mean of the polygon's vertices."""
    p = lambda n: _get(f"$.properties.{n}")
    headline = F.coalesce(p("info_headline"), F.lit("Weather alert"))
    ident = F.coalesce(p("identifier"), p("OBJECTID"), headline)
    area, centre = F.nullif(p("info_area_areaDesc"), F.lit("")), vertex_mean(_get("$.geometry.coordinates"))
    text = F.concat_ws(" — ", F.nullif(headline, F.lit("")), area, F.nullif(p("info_description"), F.lit("")))
    return _record(features, record_id=F.concat(F.lit("metservice:"), ident), source_kind=F.lit("official"), source=F.lit("metservice-cap-alerts"), external_id=ident, text=F.left(text, F.lit(2000)), text_generated=F.lit(False),
                   observed_at=F.coalesce(T.instant(p("sent")), F.lit(now).cast("timestamp")), lat=centre["lat"], lng=centre["lng"], confidence=F.when(centre.isNotNull(), 0.5), method=F.when(centre.isNotNull(), "reprojected"),
                   location_text=area, hazard=T.hazard_of(F.concat_ws(" ", headline, p("info_event"))), media=F.lit("link"), url=F.coalesce(p("info_web"), F.lit("https://metservice.com/warnings/home")),
                   quoted_urls=F.array().cast("array<string>"), limitations=_array("A forecast warning, not a report of an impact that has occurred."))


def water_faults(features: DataFrame, now: str, frame: tuple = model.CITY_FRAME) -> DataFrame:
    """Network jobs in the frame, house numbers taken out of what is published."""
    p = lambda n: _get(f"$.properties.{n}")
    lng, lat = _get("$.geometry.coordinates[0]").try_cast("double"), _get("$.geometry.coordinates[1]").try_cast("double")
    what = T.redact_house_numbers(F.coalesce(p("description"), F.lit("Water network fault")))
    text = F.concat_ws(" · ", F.nullif(what, F.lit("")), F.nullif(p("watertype"), F.lit("")), F.nullif(p("comm_description"), F.lit("")))
    public = F.coalesce(p("custservrequestcheck") == "Customer Service Request", F.lit(False))
    ident = F.coalesce(p("wonum"), p("OBJECTID"), F.concat_ws(",", lng.cast("string"), lat.cast("string")))
    kind = T.hazard_of(F.concat_ws(" ", text, p("watertype")))
    where = F.nullif(T.redact_house_numbers(F.coalesce(p("wsadd_formattedaddress"), F.lit(""))), F.lit(""))
    return _record(features.where(in_frame(lat, lng, frame)), record_id=F.concat(F.lit("water-fault:"), F.coalesce(p("OBJECTID"), ident)), source_kind=F.when(public, "official_crowd").otherwise("official"), source=F.lit("wellington-water-faults"),
                   external_id=ident, text=text, text_generated=F.lit(False), observed_at=F.coalesce(F.timestamp_millis(p("reportdate").try_cast("long")), F.lit(now).cast("timestamp")), lat=lat, lng=lng, confidence=F.lit(0.95),
                   method=F.lit("reprojected"), location_text=where, hazard=F.when(kind == "other", "water").otherwise(kind), media=F.lit("none"), quoted_urls=F.array().cast("array<string>"),
                   limitations=_array("Street numbers removed to avoid publishing personal information."))


def bluesky_posts(posts: DataFrame, now: str, salt: str) -> DataFrame:
    """Posts with text and uri; media by the embed, place and links by the words, handles as pseudonyms."""
    g = lambda path: _get(path, "post")
    text, uri, handle = F.trim(g("$.record.text")), g("$.uri"), g("$.author.handle")
    embed = F.concat(g("$.embed"), F.lit(""))
    kind = F.regexp_extract(F.coalesce(embed, F.lit("")), r'"\$type"\s*:\s*"([^"]*)"', 1)
    place = T.place_of(text)
    link = F.when(handle.isNotNull(), F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), F.element_at(F.split(uri, "/"), -1)))
    outside = g("$.embed.external.uri")
    return _record(posts.where((text != "") & uri.isNotNull()), record_id=F.concat(F.lit("bluesky:"), uri), source_kind=F.lit("social"), source=F.lit("bluesky-search"), external_id=uri, text=text, text_generated=F.lit(False),
                   observed_at=F.coalesce(T.instant(g("$.record.createdAt")), F.lit(now).cast("timestamp")), lat=place["lat"], lng=place["lng"], confidence=place["confidence"], method=F.when(place.isNotNull(), "place-name"),
                   location_text=place["place"], hazard=T.hazard_of(text), media=T.media_of_embed(kind), url=link, quoted_urls=F.array_compact(F.concat(T.urls(text), F.array(outside))), author=T.pseudonym(handle, salt),
                   limitations=_array("Unverified public social media post — a signal to investigate, not confirmed fact."))


ATOM = "entry array<struct<title:string,id:string,updated:string,published:string,content:string,summary:string,link:array<struct<_href:string>>,author:struct<name:string>>>"
RSS = "channel struct<item:array<struct<title:string,guid:string,link:string,pubDate:string,description:string>>>"


def _entries(docs: DataFrame, schema: str, path: str, column: str = "xml") -> DataFrame:
    options = {"mode": "PERMISSIVE", "valueTag": "_VALUE"}
    bare = F.regexp_replace(F.regexp_replace(column, r'\sxmlns(:\w+)?="[^"]*"', ""), r"<(/?)\w+:", "<$1")
    return docs.select("*", F.explode(F.from_xml(bare, schema, options)[path.split(".")[0]] if "." not in path else F.from_xml(bare, schema, options)[path.split(".")[0]][path.split(".")[1]]).alias("e"))


def atom_posts(docs: DataFrame, now: str, group: str, salt: str) -> DataFrame:
    """Entries of a forum's Atom feed: title — body, unless the body only says who submitted it."""
    e = _entries(docs, ATOM, "entry")
    title, content = T.decode_entities(F.trim("e.title")), T.decode_entities(F.coalesce("e.content", F.lit("")))
    body, link = T.strip_html(content), F.element_at("e.link", 1)["_href"]
    text = F.when((body != "") & ~body.startswith("submitted by"), F.concat(title, F.lit(" — "), body)).otherwise(title)
    search = F.concat_ws(" ", title, body)
    place = T.place_of(search)
    links = F.filter(T.urls(content), lambda u: ~u.contains("reddit.com"))
    return _record(e.where("e.title IS NOT NULL AND e.id IS NOT NULL"), record_id=F.concat(F.lit("reddit:"), "e.id"), source_kind=F.lit("social"), source=F.lit(f"reddit-r-{group.lower()}"), external_id=F.col("e.id"), text=F.left(text, F.lit(2000)),
                   text_generated=F.lit(False), observed_at=F.coalesce(T.instant(F.col("e.updated")), T.instant(F.col("e.published")), F.lit(now).cast("timestamp")), lat=place["lat"], lng=place["lng"], confidence=place["confidence"],
                   method=F.when(place.isNotNull(), "place-name"), location_text=place["place"], hazard=T.hazard_of(search), media=T.media_of_post(content, link), url=link, quoted_urls=links, author=T.pseudonym(F.trim("e.author.name"), salt),
                   limitations=_array("Unverified public social media post — a signal to investigate, not confirmed fact."))


def harvest(docs: DataFrame, kind: str) -> DataFrame:
    """One schema for feeds (columns source_id, tier, publisher, body): rss, atom, mastodon, quake or intensity."""
    if kind in ("rss", "atom"):
        e = _entries(docs, RSS if kind == "rss" else ATOM, "channel.item" if kind == "rss" else "entry", "body")
        link = F.col("e.link") if kind == "rss" else F.element_at("e.link", 1)["_href"]
        ident = F.coalesce(F.nullif(F.col("e.guid" if kind == "rss" else "e.id"), F.lit("")), link)
        at = F.col("e.pubDate") if kind == "rss" else F.coalesce("e.updated", "e.published")
        text = F.col("e.description") if kind == "rss" else F.coalesce("e.content", "e.summary")
        author = F.lit(None).cast("string") if kind == "rss" else F.col("e.author.name")
        rows = e.select("source_id", "tier", "publisher", ident.alias("ext"), link.alias("url"), at.alias("at"), T.strip_html(F.col("e.title")).alias("title"), T.strip_html(text).alias("text"), author.alias("author"))
    elif kind == "mastodon":
        p = docs.select("source_id", "tier", "publisher", F.explode(F.from_json("body", "array<struct<uri:string,url:string,created_at:string,content:string,account:struct<acct:string>>>")).alias("e"))
        rows = p.select("source_id", "tier", "publisher", F.col("e.uri").alias("ext"), F.coalesce("e.url", "e.uri").alias("url"), F.col("e.created_at").alias("at"), F.lit(None).cast("string").alias("title"), T.strip_html(F.col("e.content")).alias("text"), F.col("e.account.acct").alias("author"))
    else:
        f = docs.select("source_id", "tier", "publisher", F.explode(F.from_json("body", "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:struct<publicID:string,time:string,magnitude:double,mmi:double,depth:double,quality:string,locality:string,count:int>>>>")["features"]).alias("e"))
        q = F.col("e.properties")
        whole = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
        if kind == "quake":
            cols = (q["publicID"], F.concat(F.lit("https://www.geonet.org.nz/earthquake/"), q["publicID"]), q["time"], F.format_string("M%.1f earthquake, %s", q["magnitude"], q["locality"]), F.format_string("MMI %s, depth %.0f km, quality %s", whole(q["mmi"]), q["depth"], q["quality"]))
        else:
            xy = F.col("e.geometry.coordinates")
            cols = (F.concat(F.lit("felt:"), xy[0].cast("string"), F.lit(","), xy[1].cast("string"), F.lit(":"), whole(q["mmi"])), F.lit("https://www.geonet.org.nz/earthquake/report"), F.lit(None).cast("string"), F.concat(F.lit("Felt report cluster, MMI "), whole(q["mmi"])), F.concat(F.coalesce(q["count"], F.lit(0)).cast("string"), F.lit(" public reports")))
        rows = f.select("source_id", "tier", "publisher", *(c.alias(n) for c, n in zip(cols, ("ext", "url", "at", "title", "text"), strict=True)), F.lit(None).cast("string").alias("author"))
    body = F.concat_ws(" ", "title", "text")
    return rows.select(
        F.left(F.sha2(F.concat_ws(":", "source_id", "ext"), 256), F.lit(16)).alias("id"), "source_id", "tier", "publisher", "url", T.iso(T.instant(F.col("at"))).alias("published_at"), "title", "text",
        T.plain_pseudonym(F.col("author")).alias("author"), T.independence_key(F.col("author"), F.col("publisher")).alias("independence_key"), T.fingerprint(body).alias("fingerprint"),
        T.sorted_hits(body, T.PLACE_TERMS).alias("hint_places"), T.sorted_hits(body, T.IMPACT_TERMS).alias("hint_impacts"),
    )


def harvest_report(records: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, rows, hits (both kinds of hint), warned: per source, also those that gave nothing."""
    got = records.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.size("hint_places") > 0) & (F.size("hint_impacts") > 0)).alias("hits"))
    return sources.select("source_id").join(got, "source_id", "left").na.fill(0, ["rows", "hits"]).withColumn("warned", F.col("rows") == 0)


def cap_history(docs: DataFrame, words: tuple[str, ...] = ("wellington", "hutt", "porirua", "kapiti")) -> DataFrame:
    """One row per info block of archived warnings (columns url, xml)."""
    schema = "identifier string, sent string, info array<struct<event:string,headline:string,severity:string,urgency:string,certainty:string,onset:string,expires:string,description:string,instruction:string,area:struct<areaDesc:string,polygon:string>>>"
    bare = F.regexp_replace("xml", r'\sxmlns(:\w+)?="[^"]*"', "")
    e = docs.select("url", F.from_xml(bare, schema).alias("a")).select("url", "a.identifier", "a.sent", F.explode("a.info").alias("i"))
    area = F.coalesce("i.area.areaDesc", F.lit(""))
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(area), w))
    points = F.when(F.trim("i.area.polygon") != "", F.size(F.split(F.trim("i.area.polygon"), r"\s+"))).otherwise(0)
    return e.where("i.event IS NOT NULL OR i.headline IS NOT NULL").select("identifier", "sent", "i.event", "i.headline", "i.severity", "i.urgency", "i.certainty", "i.onset", "i.expires", area.alias("area"), "i.description", "i.instruction", points.alias("polygon_points"), named.alias("relevant"), F.col("url").alias("source_url"))


def load_feeds(posts: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Posts (platform, feed, title, text, posted_at, post_id, author, url) as items; empty ones and old ones go."""
    said = F.trim(F.coalesce("text", "title", F.lit("")))
    both = F.concat_ws(" — ", F.nullif("title", F.lit("")), F.nullif("text", F.lit("")))
    kept = posts.where(said != "")
    kept = kept.where(F.col("posted_at") >= F.lit(cutoff).cast("timestamp")) if cutoff else kept
    return kept.select(
        "post_id", F.left(both, F.lit(4000)).alias("text"), F.concat_ws("-", F.nullif("platform", F.lit("")), F.nullif("feed", F.lit(""))).alias("source"), F.when(F.col("platform") == "news", "media").otherwise("social").alias("source_class"),
        F.col("posted_at").alias("occurred_at"), F.col("post_id").cast("string").alias("external_id"), "author", "url", T.feed_hazard_of(F.concat_ws(" ", "title", "text")).alias("hazard"), F.lit(0.6).alias("hazard_confidence"),
    )


def to_upload_items(records: DataFrame, dataset_id: str, synthetic: bool = False) -> DataFrame:
    """Records as items with their annotations: place wording (the matched place first), image, method, whether the text
    was composed, limitations."""
    a = lambda k, v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
    place = F.coalesce("matched_place", "location_text") if "matched_place" in records.columns else F.col("location_text")
    image = F.col("media_url") if "media_url" in records.columns else F.lit(None)
    notes = F.array_compact(F.array(a("location_text", place), a("image_url", image), a("location_method", F.coalesce("method", F.lit("none"))), a("text_generated", F.col("text_generated"))))
    limits = F.transform(F.coalesce("limitations", F.array().cast("array<string>")), lambda v: F.struct(F.lit("limitation").alias("key"), v.alias("value")))
    classes = F.create_map(*(F.lit(x) for kv in KIND_CLASS.items() for x in kv))
    return records.select("record_id", "text", "source", F.coalesce(F.try_element_at(classes, F.col("source_kind")), F.col("source_kind")).alias("source_class"), F.col("observed_at").alias("occurred_at"), "external_id", "author", "url", "quoted_urls", "lat", "lng",
                          F.col("confidence").alias("geo_confidence"), F.concat(notes, limits).alias("annotations"), F.lit(dataset_id).alias("dataset_id"), F.lit(synthetic).alias("synthetic"))


def slide_times(items: DataFrame, now: str, newest_minutes: int = 5) -> DataFrame:
    """The whole set moved so that its newest item is ``newest_minutes`` old; gaps stay. Capture lags by 3 to 8 minutes
    by position ``pos``, never before the event nor within half a minute of ``now``."""
    end = F.unix_micros(F.lit(now).cast("timestamp"))
    top = items.agg(F.max("occurred_at").alias("_top"))
    shift = end - newest_minutes * 60_000_000 - F.unix_micros("_top")
    at = F.unix_micros("occurred_at") + shift
    lag = (3 + (F.col("pos") * 7) % 6) * 60_000_000
    heard = F.greatest(at, F.least(at + lag, end - 30_000_000))
    return items.join(F.broadcast(top)).withColumn("captured_at", F.timestamp_micros(heard)).withColumn("occurred_at", F.timestamp_micros(at)).drop("_top")
