"""Reading arbitrary JSON reports as items and annotations.

A payload becomes an array of (key, value, kind) in payload order, with containers lifted into it.  The first alias that
gives a value wins and is consumed; what is left over becomes annotations.  Values are told apart by their JSON type, not
by how they begin: a text may start with a bracket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witness.functions.text import humanise, instant, strip_end

# The aliases of each field, first one that gives a value wins.
ALIASES = {
    "source": ("source", "source_name", "sourceName", "feed", "origin", "publisher", "author"),
    "source_class": ("source_class", "sourceClass", "source_type", "sourceType"),
    "captured_at": ("captured_at", "capturedAt", "ingested_at", "ingestedAt", "collected_at"),
    "occurred_at": ("occurred_at", "occurredAt", "observed_at", "observedAt", "timestamp", "datetime", "time", "date", "published_at", "created_at"),
    "lat": ("lat", "latitude"),
    "lng": ("lng", "lon", "long", "longitude"),
    "geo_confidence": ("geo_confidence", "geoConfidence"),
    "dataset_id": ("dataset_id", "datasetId", "dataset"),
    "external_id": ("external_id", "externalId", "item_id", "itemId", "guid", "id"),
    "author": ("author", "username", "screen_name", "screenName", "byline", "user"),
    "url": ("url", "link", "permalink", "source_url", "sourceUrl"),
    "quoted_urls": ("quoted_urls", "quotedUrls", "quoted_url", "quotedUrl", "in_reply_to_url"),
    "synthetic": ("synthetic", "is_synthetic", "isSynthetic", "fixture"),
    "title": ("title", "headline", "subject"),
    "text": ("text", "content", "body", "message", "description", "summary", "report", "note"),
}
CONTAINERS = ("meta", "metadata", "properties", "attributes", "fields")
GEO_CONTAINERS = ("location", "geo", "position", "point", "geometry", "coordinates")
MAX_TEXT, MAX_VALUE = 4000, 2000
UNKNOWN = "unknown"


_NUL = r"(?<!\\)((?:\\\\)*)\\u0000"  # the escape, not an escaped backslash before u0000
_ENTRIES = "array<struct<key:string,value:string,kind:string>>"
_KINDS = (("STRING", "text"), ("BIGINT", "scalar"), ("DOUBLE", "scalar"), ("DECIMAL", "scalar"), ("BOOLEAN", "scalar"), ("ARRAY", "array"), ("OBJECT", "object"))
_NOTES = "array<struct<key:string,value:string,confidence:double,annotator:string>>"


def strip_nul(json: Column) -> Column:
    """Without U+0000, raw or escaped."""
    return F.regexp_replace(F.replace(json, F.lit("\x00"), F.lit("")), _NUL, "$1")


def has_nul(json: Column) -> Column:
    return F.contains(json, F.lit("\x00")) | json.rlike(_NUL)


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose results later steps refer to and don't spell out again, be it inside a lambda.

    They come as the one row of an inline array, which the optimizer leaves in its place.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def kind_of(value: Column) -> Column:
    """text, scalar (number or boolean), array, object, or null, of a variant."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _KINDS for x in pair)), name)


def text_of(value: Column) -> Column:
    """A variant's scalar as trimmed text, null for null and for arrays and objects."""
    return F.when(kind_of(value).isin("text", "scalar"), F.trim(F.try_variant_get(value, "$", "string")))


def pairs_of(values: Column, kinds: Column) -> Column:
    """Entries of an object read twice: with its values as they are written, and with their types.

    A key written twice stands where it first stood, with its last value.  A number too large for a double reads as
    Infinity.  Where an object further in has a key twice there are no types; values then tell theirs by how they begin.
    """
    looks = lambda v: F.when(v.startswith("{"), "object").when(v.startswith("["), "array").when(v.isNotNull(), "text")
    found = F.transform(
        F.map_entries(values),
        lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.when(kinds.isNull(), looks(e["value"])).otherwise(kind_of(F.get(kinds, i))).alias("kind")),
    )
    plain = lambda e: F.struct(
        e["key"].alias("key"), F.when(e["value"].isin('"Infinity"', '"-Infinity"'), F.replace(e["value"], F.lit('"'), F.lit(""))).otherwise(e["value"]).alias("value"), e["kind"].alias("kind")
    )
    once = F.transform(F.array_distinct(F.map_keys(values)), lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1))
    return F.transform(F.when(F.size(F.array_distinct(F.map_keys(values))) < F.size(F.map_keys(values)), once).otherwise(found), plain)


def with_entries(df: DataFrame, json: str) -> DataFrame:
    """Adds _e: the entries of the object in column ``json``; the top level wins over containers, earlier containers over
    later ones, and of a key written twice in one object the last counts."""
    values = lambda c: F.from_json(c, "map<string,string>")
    kinds = lambda c: F.map_values(F.from_json(c, "map<string,variant>"))
    df = settle(df, _v=values(F.col(json)), _k=kinds(F.col(json)))
    inner = {n: F.when(F.col("_v")[n].startswith("{"), F.col("_v")[n]) for n in CONTAINERS}
    df = settle(df, _top=pairs_of(F.col("_v"), F.col("_k")), **{f"_v_{n}": values(c) for n, c in inner.items()}, **{f"_k_{n}": kinds(c) for n, c in inner.items()})
    empty = F.array().cast(_ENTRIES)
    lifted = [F.when(F.col(f"_v_{n}").isNotNull(), pairs_of(F.col(f"_v_{n}"), F.col(f"_k_{n}"))) for n in CONTAINERS]
    df = settle(df, _all=F.concat(*(F.coalesce(x, empty) for x in (F.col("_top"), *lifted))))
    df = settle(df, _names=F.transform("_all", lambda x: x["key"]))
    return settle(df, _e=F.filter("_all", lambda x, i: F.array_position("_names", x["key"]) == i + 1))


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds _c: the entries that are some field's alias, as (field, rank, key, value, kind)."""
    known = [(key, name, rank) for name, keys in (*ALIASES.items(), ("box", GEO_CONTAINERS)) for rank, key in enumerate(keys)]
    known = {key: (name, rank) for key, name, rank in known}  # "author" is the author's first; see ``adapt``
    field = F.create_map(*(F.lit(x) for k, (name, _) in known.items() for x in (k, name)))
    rank = F.create_map(*(F.lit(x) for k, (_, n) in known.items() for x in (k, n)))
    named = lambda e: F.struct(
        F.try_element_at(field, e["key"]).alias("field"), F.try_element_at(rank, e["key"]).alias("rank"),
        e["key"].alias("key"), F.trim(e["value"]).alias("value"), e["kind"].alias("kind"),
    )
    return settle(df, _c=F.filter(F.transform("_e", named), lambda c: c["field"].isNotNull()))


def take(field: str, good: Callable[[Column], Column] | None = None, closed: Column | None = None) -> Column:
    """(key, value) of a field's first alias with a non-blank scalar that ``good`` accepts; ``closed`` is a key already used."""

    def fits(c: Column) -> Column:
        ok = (c["field"] == field) & c["kind"].isin("text", "scalar") & (c["value"] != "")
        ok = ok & (c["key"] != F.coalesce(closed, F.lit(""))) if closed is not None else ok
        return ok & good(c["value"]) if good is not None else ok

    return _first(F.filter("_c", fits), "key", "value")


def _first(candidates: Column, *names: str) -> Column:
    best = F.array_min(F.transform(candidates, lambda c: F.struct(c["rank"].alias("rank"), *(c[n].alias(n) for n in names))))
    return F.when(best.isNotNull(), F.struct(*(best[n].alias(n) for n in names)))


def boolean_of(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def instant_of(value: Column) -> Column:
    """Epoch milliseconds or seconds by size, or a date in a known format; smaller numbers are no instants."""
    n = value.try_cast("double")
    return F.when(n > 1e11, F.timestamp_millis(n.cast("long"))).when(n > 1e9, F.timestamp_seconds(n)).when(n.isNull(), instant(value))


def strings_of(value: Column, kind: Column, scalars: bool = False) -> Column:
    """The non-blank strings of a JSON array (with ``scalars`` numbers and booleans too), or a single one."""
    text = text_of if scalars else lambda v: F.when(kind_of(v) == "text", F.trim(F.try_variant_get(v, "$", "string")))
    many = F.filter(F.transform(F.from_json(value, "array<variant>"), text), lambda x: x.isNotNull() & (x != ""))
    single = kind.isin("text", "scalar") if scalars else kind == "text"
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(kind == "array", many).when(single & (F.trim(value) != ""), F.array(F.trim(value))), none)


def take_array(field: str) -> Column:
    """(key, value, kind) of a field's first alias that is an array or a non-blank string, see ``strings_of``."""
    some = lambda c: (c["kind"] == "array") | ((c["kind"] == "text") & (c["value"] != ""))
    return _first(F.filter("_c", lambda c: (c["field"] == field) & some(c)), "key", "value", "kind")


def _number(v: Column) -> Column:
    return v.try_cast("double").isNotNull()


def _spot(raw: Column) -> Column:
    """(lat, lng) that a container's JSON holds: a position, a geometry, or an object with coordinates by alias."""
    pair = F.from_json(F.when(raw.startswith("["), raw).otherwise(F.get_json_object(raw, "$.coordinates")), "array<double>")
    fields = F.from_json(F.when(raw.startswith("{"), raw), "map<string,string>")
    named = lambda keys: F.coalesce(*(fields[k].try_cast("double") for k in keys))
    return F.struct(F.coalesce(F.get(pair, F.lit(1)), named(ALIASES["lat"])).alias("lat"), F.coalesce(F.get(pair, F.lit(0)), named(ALIASES["lng"])).alias("lng"))


def with_geo(df: DataFrame) -> DataFrame:
    """Adds _geo (lat, lng, confidence, dropped) and _geo_keys: by alias, else from a container in GeoJSON order; half
    or impossible pairs are dropped with a sentence."""
    held = F.filter("_c", lambda c: (c["field"] == "box") & c["kind"].isin("array", "object"))
    boxes = F.transform(held, lambda c: F.struct(c["rank"].alias("rank"), c["key"].alias("key"), _spot(c["value"]).alias("at")))
    df = settle(df, _boxes=boxes, _la=take("lat", _number), _lo=take("lng", _number), _co=take("geo_confidence", _number))
    df = settle(df, _box=_first(F.filter("_boxes", lambda b: b["at"]["lat"].isNotNull() & b["at"]["lng"].isNotNull()), "key", "at"))
    boxed = ~(F.col("_la").isNotNull() & F.col("_lo").isNotNull()) & F.col("_box").isNotNull()
    pick = lambda c, n: F.when(boxed, F.col("_box.at")[n]).otherwise(F.col(f"{c}.value").try_cast("double"))
    df = settle(df, _y=pick("_la", "lat"), _x=pick("_lo", "lng"), _boxed=boxed)
    y, x = F.col("_y"), F.col("_x")
    fits = y.between(-90, 90) & x.between(-180, 180)
    word = lambda v: F.coalesce(v.cast("string"), F.lit("absent"))
    place = F.concat(F.lit("(lat="), word(y), F.lit(", lng="), word(x), F.lit(")"))
    dropped = (
        F.when(y.isNull() & x.isNull(), F.lit(None))
        .when(y.isNull() | x.isNull(), F.concat(F.lit("incomplete coordinates "), place))
        .when(~fits, F.concat(F.lit("coordinates out of range "), place))
    )
    confidence = F.coalesce(F.col("_co.value").try_cast("double"), F.lit(1.0))
    geo = F.struct(F.when(fits, y).alias("lat"), F.when(fits, x).alias("lng"), F.when(fits, confidence).alias("confidence"), dropped.alias("dropped"))
    return settle(df, _geo=geo, _geo_keys=F.array("_la.key", "_lo.key", "_co.key", F.when(F.col("_boxed"), F.col("_box.key"))))


def derive_text(entries: Column, title: Column, body: Column, consumed: Column) -> Column:
    """Title and body, either alone, or the leftover scalars as a sentence in payload order."""
    left = F.filter(entries, lambda e: ~F.array_contains(consumed, e["key"]) & e["kind"].isin("text", "scalar") & (F.trim(e["value"]) != ""))
    rendered = F.array_join(F.transform(left, lambda e: F.concat(humanise(e["key"]), F.lit(": "), F.trim(e["value"]))), "; ")
    both = F.when(title.isNotNull() & body.isNotNull(), F.concat(strip_end(title), F.lit(" — "), body))
    return F.coalesce(both, body, title, F.when(rendered != "", rendered))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def _note(key: Column, value: Column, annotator: Column | str = "feed", confidence: Column | None = None) -> Column:
    who = F.lit(annotator) if isinstance(annotator, str) else annotator
    sure = F.lit(None) if confidence is None else confidence
    return F.struct(key.alias("key"), shorten(value, MAX_VALUE).alias("value"), sure.cast("double").alias("confidence"), who.alias("annotator"))


def _scalar_notes(json: Column) -> Column:
    """A note for each scalar of an object."""
    pairs = F.transform(F.map_entries(F.from_json(json, "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), text_of(e["value"]).alias("value")))
    return F.transform(F.filter(pairs, lambda e: e["value"].isNotNull()), lambda e: _note(e["key"], e["value"]))


def _listed_note(item: Column) -> Column:
    """What one member of a list of annotations says: an object with a key, or a scalar; null for anything else."""
    field = lambda name, kind: F.try_variant_get(item, f"$.{name}", kind)
    key = F.when(kind_of(field("key", "variant")) == "text", F.trim(field("key", "string")))
    sure = field("confidence", "double")
    value = F.coalesce(text_of(field("value", "variant")), F.to_json(field("value", "variant")), F.lit(""))
    full = _note(key, value, F.coalesce(F.nullif(field("annotator", "string"), F.lit("")), F.lit("feed")), F.when(sure.between(0, 1), sure))
    plain = text_of(item)
    return F.when(F.coalesce(key, F.lit("")) != "", full).when(plain.isNotNull(), _note(F.lit("annotation"), plain))


def explicit_notes(entry: Callable[[str], Column]) -> Column:
    """Annotations that the payload gives as such (list, object or scalar), then its tags (the same)."""
    notes, tags = entry("annotations"), entry("tags")
    members = F.transform(F.from_json(notes["value"], "array<variant>"), _listed_note)
    given = (
        F.when(notes["kind"] == "array", F.filter(members, lambda n: n.isNotNull()))
        .when(notes["kind"] == "object", _scalar_notes(notes["value"]))
        .when(notes["kind"].isNotNull(), F.array(_note(F.lit("annotation"), F.trim(notes["value"]))))
    )
    each = F.transform(strings_of(tags["value"], tags["kind"], True), lambda t: _note(F.lit("tag"), t))
    marked = F.when(tags["kind"] == "object", _scalar_notes(tags["value"])).when(tags["kind"].isNotNull(), each)
    none = F.array().cast(_NOTES)
    return F.concat(F.coalesce(given, none), F.coalesce(marked, none))


def adapt(rows: DataFrame, now: str, payload: str = "payload") -> DataFrame:
    """Adds ok, reason, the item's columns and ``annotations`` (array of key, value, confidence, annotator).

    A bare string is a report of its own; anything but an object or a string is refused.  Nothing is lost: ``payload``
    stays as it is, and every scalar becomes a column or an annotation.
    """
    raw = F.col("_raw")
    out = settle(rows, _raw=F.trim(strip_nul(F.col(payload))))
    out = settle(out, _json=F.when(raw.startswith("{"), raw), _bare=F.when(raw.startswith('"'), F.trim(F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0)))))
    out = with_entries(out, "_json")
    out = settle(out, _f=F.map_from_entries(F.transform("_e", lambda x: F.struct(x["key"], F.struct(x["value"], x["kind"])))))
    is_object, bare, entry = F.col("_v").isNotNull(), F.col("_bare"), lambda k: F.col("_f")[k]
    good = {"captured_at": lambda v: instant_of(v).isNotNull(), "occurred_at": lambda v: instant_of(v).isNotNull(), "synthetic": lambda v: boolean_of(v).isNotNull()}
    one = ("source_class", "captured_at", "occurred_at", "dataset_id", "external_id", "url", "synthetic", "title", "text")
    out = settle(with_candidates(out), _f_named=take("source"), **{f"_f_{n}": take(n, good.get(n)) for n in one}, _f_quoted_urls=take_array("quoted_urls"))
    # An alias that one field has consumed is closed to the next. Of all lists only two overlap: a source's last alias is
    # an author's first.
    own = F.filter("_c", lambda c: (c["key"] == ALIASES["source"][-1]) & c["kind"].isin("text", "scalar") & (c["value"] != ""))
    out = settle(out, _f_source=F.coalesce("_f_named", _first(own, "key", "value")))
    out = settle(out, _f_author=take("author", closed=F.col("_f_source.key")))
    out = with_geo(out)
    used = F.array_compact(F.concat(F.array(*(f"_f_{n}.key" for n in (*one, "source", "quoted_urls", "author"))), "_geo_keys"))
    out = settle(out, _used=used, _given=explicit_notes(entry))
    value = lambda n: F.col(f"_f_{n}.value")
    out = settle(out, _text=F.coalesce(bare, derive_text(F.col("_e"), value("title"), value("text"), F.col("_used"))))
    left = F.filter("_e", lambda x: ~F.array_contains("_used", x["key"]) & ~x["key"].isin("annotations", "tags") & x["kind"].isin("text", "scalar"))
    out = settle(out, _notes=F.concat("_given", F.transform(left, lambda x: _note(x["key"], F.trim(x["value"])))))
    ok = (is_object | bare.isNotNull()) & (F.coalesce(F.trim("_text"), F.lit("")) != "")
    note = lambda key, said, who="feed": _note(F.lit(key), said, who)
    told = F.exists("_notes", lambda n: n["key"] == "source_url")
    extra = F.array_compact(F.array(
        F.when(F.length("_text") > MAX_TEXT, note("text_truncated", F.lit("true"))),
        F.when(F.col("_geo.dropped").isNotNull(), note("geo_dropped", F.col("_geo.dropped"), "rule")),
        F.when(value("url").isNotNull() & ~told, note("source_url", value("url"))),
        F.when(boolean_of(value("synthetic")), note("synthetic", F.lit("true"))),
        F.when(value("occurred_at").isNull(), note("assumed_occurred_at", F.lit("true"), "rule")),
        F.when(value("captured_at").isNotNull(), note("declared_captured_at", value("captured_at"))),
        F.when(has_nul(F.col(payload)), note("nul_bytes_stripped", F.lit("true"), "rule")),
    ))
    captured = F.coalesce(instant_of(value("captured_at")), F.lit(now).cast("timestamp"))
    reason = (
        F.when(ok, F.lit(None))
        .when(~is_object & bare.isNull(), "Payload must be a JSON object or string")
        .when(bare.isNotNull(), "Payload was an empty string")
        .otherwise("Could not derive any text from the payload — send a `text` field, or any readable scalar value")
    )
    item = {
        "ok": ok,
        "reason": reason,
        "source": F.coalesce(value("source"), F.lit(UNKNOWN)),
        "source_class": F.coalesce(value("source_class"), F.lit(UNKNOWN)),
        "text": shorten(F.col("_text"), MAX_TEXT),
        "dataset_id": F.coalesce(value("dataset_id"), F.lit("live")),
        "external_id": value("external_id"),
        "author": value("author"),
        "url": value("url"),
        "quoted_urls": strings_of(value("quoted_urls"), F.col("_f_quoted_urls.kind")),
        "synthetic": F.coalesce(boolean_of(value("synthetic")), F.lit(False)),
        "occurred_at": F.coalesce(instant_of(value("occurred_at")), captured),
        "captured_at": captured,
        "assumed_time": value("occurred_at").isNull(),
        "lat": F.col("_geo.lat"),
        "lng": F.col("_geo.lng"),
        "geo_confidence": F.col("_geo.confidence"),
        "geo_dropped": F.col("_geo.dropped"),
        "annotations": F.concat("_notes", extra),
    }
    return out.select(*rows.columns, F.inline(F.array(F.struct(*(c.alias(n) for n, c in item.items())))))


def annotations(adapted: DataFrame, key: str) -> DataFrame:
    """node_id, key, value, confidence, annotator: one row for each annotation of accepted items."""
    return adapted.where("ok").select(F.col(key).alias("node_id"), F.explode("annotations").alias("a")).select("node_id", "a.*")
