"""Grades on two axes, with the reasons in sentences; transitions and alerts.

``facts`` has one row per bubble: origins, items, reliability, best_source, registered, unregistered, location, time,
cross_check, cross_detail, issue, last_seen.  ``now`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from witness import model
from witness.functions.text import let
from witness.functions.geo import words_of_hours
from witness.operators.running import numbered, running
from witness.operators.store import with_reliability


def location_certainty() -> Column:
    """Aggregate over a bubble's items."""
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    sure = placed & (F.col("geo_confidence").isNull() | (F.col("geo_confidence") >= 1))
    return F.when(~F.bool_or(placed), "unknown").when(F.bool_or(sure), "stated").otherwise("inferred")


def time_certainty() -> Column:
    return F.when(F.count(F.lit(1)) == 0, "unknown").when(F.bool_or(~F.col("assumed_time")), "stated").otherwise("assumed")


def best_reliability(members: DataFrame, registry: DataFrame) -> DataFrame:
    """bubble_id, reliability, best_source, registered, unregistered; F where no source is known."""
    seen = with_reliability(members.select("bubble_id", "source").distinct(), registry)
    known = F.col("reliability").isNotNull()
    best = F.min(F.when(known, F.struct("reliability", "source")))
    return (
        seen.groupBy("bubble_id").agg(best.alias("b"), F.count_if(known).alias("registered"), F.count_if(~known).alias("unregistered"))
        .select("bubble_id", F.coalesce("b.reliability", F.lit("F")).alias("reliability"), F.col("b.source").alias("best_source"), "registered", "unregistered")
    )


def issue_types(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, issue: the class with most different phrases in any of the texts; ties by the list; none is ``other``.

    Each text is searched by itself: which of a class's phrases occurred is a bit each, put together over a bubble's texts.
    """
    width = 63
    pieces = [(issue, words[k : k + width]) for issue, (_, words) in model.ISSUES.items() for words in [tuple(dict.fromkeys(words))] for k in range(0, len(words), width)]
    bits = lambda low, words: sum((F.when(low.contains(w), 1 << k).otherwise(0).cast("long") for k, w in enumerate(words)), F.lit(0).cast("long"))
    marked = texts.select(by, let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array(*(bits(low, words) for _, words in pieces))).alias("m"))
    told = marked.groupBy(by).agg(*(F.bit_or(F.get("m", F.lit(k))).alias(f"m{k}") for k in range(len(pieces))))
    count = lambda issue: sum((F.bit_count(f"m{k}") for k, (i, _) in enumerate(pieces) if i == issue), F.lit(0))
    most = F.greatest(*(count(i) for i in model.ISSUES))
    found = F.lit(model.OTHER_ISSUE)
    for issue in reversed(model.ISSUES):
        found = F.when(F.col(by).isNotNull() & (most > 0) & (count(issue) == most), issue).otherwise(found)
    return told.select(by, found.alias("issue"))


def half_life(issue: Column) -> Column:
    table = F.create_map(*(F.lit(x) for i, (h, _) in model.ISSUES.items() for x in (i, h)))
    return F.coalesce(F.try_element_at(table, issue), F.lit(model.OTHER_HALF_LIFE))


def age_hours(last_seen: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(last_seen)) / 3.6e9


def freshness(issue: Column, last_seen: Column, now: str) -> Column:
    hours = age_hours(last_seen, now)
    return F.when(hours <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(F.lit(0.5), hours / half_life(issue)))))


def credibility(location: Column, time: Column, origins: Column, cross: Column, contradicting: Column | None = None) -> Column:
    """2 to 6 by the rule table, before the floor of registered sources; 1 is a person's word only."""
    against = (cross == "inconsistent") | (contradicting > 0 if contradicting is not None else F.lit(False))
    return (
        F.when((location == "unknown") | (time == "unknown"), 6).when(against, 5)
        .when((origins >= 2) & (cross == "consistent"), 2).when((origins >= 2) | (cross == "consistent"), 3).otherwise(4)
    )


def floored(reliability: Column, cred: Column) -> Column:
    return F.when((reliability == "A") & (cred == 4), 3).otherwise(cred)


def checked(cred: Column) -> Column:
    """The credibility, or an error where it isn't one that a rule may give."""
    return F.when(cred.between(2, 6), cred).otherwise(F.raise_error(F.concat(F.lit("credibility out of range: "), F.coalesce(cred.cast("string"), F.lit("null")))).cast("int"))


def _label(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def grade_label(reliability: Column, cred: Column) -> Column:
    words = F.coalesce(_label(model.CREDIBILITY_LABELS, cred), F.lit("unknown credibility"))
    return F.concat(reliability, cred.cast("string"), F.lit(" — "), _label(model.RELIABILITY_LABELS, reliability), F.lit(" / "), words)


def tone(cred: Column) -> Column:
    """confirmed, corroborated, unclear or doubtful; none where it can't be judged yet."""
    return F.coalesce(_label(model.TONES, cred), F.lit("can't judge yet"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def graded(facts: DataFrame, now: str) -> DataFrame:
    """Adds credibility, label, freshness, alert_worthy, reasons and alert_reasons to one row of facts per bubble."""
    c = F.col
    cross = F.coalesce(c("cross_check"), F.lit("no_applicable_layer"))
    origins, items, rel = c("origins"), c("items"), c("reliability")
    raw = credibility(c("location"), c("time"), origins, cross)
    cred = floored(rel, raw)
    against, corroborated = cross == "inconsistent", origins >= 2
    fresh = freshness(c("issue"), c("last_seen"), now)
    hours = age_hours(c("last_seen"), now)
    worthy = (c("location") != "unknown") & ~against
    detail = lambda d: F.when(c("cross_detail").isNotNull(), F.concat(F.lit(d), c("cross_detail"))).otherwise("")
    # The published sentences.
    evidence = F.concat(plural(origins, "independent origin"), F.lit(" behind "), plural(items, "item"), F.when(items == origins, "").otherwise(
        F.concat(F.lit(" — "), (items - origins).cast("string"), F.lit(" collapsed as the same observation restated"))))
    source = F.when(c("best_source").isNotNull(), F.concat(F.lit('the source "'), c("best_source"), F.lit('"'))).otherwise("a contributing source")
    rule = (
        F.when(c("location") == "unknown", F.concat(F.lit("no contributing report could be placed on a map, so this cannot be judged — "), evidence, F.lit(" with no resolvable location")))
        .when(c("time") == "unknown", F.concat(F.lit("no contributing report carried a resolvable time, so this cannot be judged — "), evidence))
        .when(against, F.concat(F.lit("contradicted by authoritative data: "), F.coalesce("cross_detail", F.lit("the applicable hazard layer disagrees with this claim"))))
        .when(corroborated & (cross == "consistent"), F.concat(evidence, F.lit(", AND authoritative data agrees — corroboration on both axes")))
        .when(corroborated, F.concat(evidence, F.lit(" — independent people, not one report repeated")))
        .when(cross == "consistent", F.concat(F.lit("only one independent origin, but authoritative data agrees with it: "), F.coalesce("cross_detail", F.lit("the applicable layer is consistent with this claim"))))
        .otherwise(F.concat(evidence, F.lit(' and nothing yet agrees with it — uncorroborated, which is what "doubtful" means here, not "false"')))
    )
    override = F.when((rel == "A") & (raw == 4), F.concat(source, F.lit(" is registered A (completely reliable), so credibility is floored at 3 regardless of how few origins there are"))).when(
        (rel == "A") & (raw > 4), F.concat(source, F.lit(" is registered A, but the A-source floor lifts a cluster only where corroboration is the weakness — it does not overturn "),
                                           F.when(raw == 5, "a contradiction").otherwise("an unresolvable location or time")))
    check = F.when(cross == "consistent", F.concat(F.lit("authoritative cross-check: consistent"), detail(" — "))).when(
        against, F.concat(F.lit("authoritative cross-check: INCONSISTENT"), detail(" — "))
    ).otherwise(F.concat(F.lit("authoritative cross-check: no applicable layer"), detail(" — "), F.lit(", so nothing has confirmed or denied this")))
    total = c("registered") + c("unregistered")
    crowd = F.when(c("unregistered") > 0, F.concat(F.lit("; this axis reports the best source, not the crowd — "), c("unregistered").cast("string"), F.lit(" of the "), plural(total, "contributing source"),
                                                   F.when(c("unregistered") == 1, " is").otherwise(" are"), F.lit(" unregistered and grade F on their own"))).otherwise("")
    trust = F.when(rel == "F", F.concat(F.lit("source reliability F: "), F.when(c("best_source").isNotNull(), F.concat(F.lit('"'), c("best_source"), F.lit('" is registered F'))).otherwise("no contributing source is in the registry"), F.lit(" — unknown, not mediocre"))).otherwise(
        F.concat(F.lit("source reliability "), rel, F.lit(" ("), _label(model.RELIABILITY_LABELS, rel), F.lit("), earned by "), source, F.lit(" — the best among the contributing sources"), crowd))
    place = F.when(c("location") == "inferred", "location was INFERRED from the reports rather than stated by any source — treat the point as an area").when(
        c("location") == "unknown", "no contributing report could be placed: this signal is real evidence that cannot be drawn on a map")
    clock = F.when(c("time") == "assumed", "no contributing report carried its own timestamp; ingest time was assumed, so the event may be older than it looks").when(
        c("time") == "unknown", "no contributing report carried a resolvable time")
    what = F.replace(c("issue"), F.lit("_"), F.lit(" "))
    current = F.concat(F.lit("freshness "), F.format_string("%.2f", fresh), F.lit(" — "), what, F.lit(" halves every "), half_life(c("issue")).cast("string"), F.lit("h and the most recent report is "), words_of_hours(hours), F.lit(" old"))
    label = grade_label(rel, cred)
    weak = [
        F.when(~corroborated, F.concat(F.lit("WEAK EVIDENCE: "), F.when(origins == 1, "one independent origin").otherwise("no independent origin"), F.lit(" behind "), plural(items, "item"), F.lit(" — this is uncorroborated, and grades "), label)),
        F.when(rel == "F", "WEAK EVIDENCE: no contributing source is in the registry, so their reliability cannot be judged at all"),
        F.when(c("location") == "inferred", "WEAK EVIDENCE: the location was inferred from the text, not stated by a source — search the area, not the pin"),
        F.when(cross == "no_applicable_layer", "WEAK EVIDENCE: no authoritative layer applies to this claim, so nothing independent has checked it"),
        F.when(fresh < 0.5, F.concat(F.lit("AGEING: freshness "), F.format_string("%.2f", fresh), F.lit(" — the newest report is more than one "), what, F.lit(" half-life old"))),
    ]
    headline = F.concat(what, F.lit(" reported at a location we can point to — worth a look now, ahead of any confirmation"))
    silent = F.when(against, "not raised: authoritative data contradicts this claim. It stays on the map and in the record — an alert is a request for attention, and this one is a request to check the contradiction first").otherwise(
        "not raised: nothing here can be placed on a map, so there is nowhere to send anyone. The evidence is kept and readable in full")
    return facts.withColumns({
        "credibility": checked(cred), "label": label, "freshness": fresh, "alert_worthy": worthy,
        "reasons": F.array_compact(F.array(rule, override, check, trust, place, clock, current)),
        "alert_reasons": F.when(worthy, F.array_compact(F.array(headline, *weak))).otherwise(F.array(silent)),
    })


def cluster_facts(members: DataFrame, origins: DataFrame, registry: DataFrame, cross_checks: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """The facts of each bubble from its items, their origins, the registry, and optional cross-check and issue frames."""
    spark = members.sparkSession
    base = members.groupBy("bubble_id").agg(
        F.count(F.lit(1)).alias("items"), location_certainty().alias("location"), time_certainty().alias("time"),
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
    )
    counted = origins.groupBy("bubble_id").agg(F.countDistinct("origin_id").alias("origins"))
    checks = cross_checks if cross_checks is not None else spark.createDataFrame([], "bubble_id string, cross_check string, cross_detail string")
    kinds = issues if issues is not None else base.select("bubble_id", F.lit(model.OTHER_ISSUE).alias("issue"))
    return (
        base.join(counted, "bubble_id").join(best_reliability(members, registry), "bubble_id")
        .join(checks, "bubble_id", "left").join(kinds, "bubble_id", "left").na.fill({"cross_check": "no_applicable_layer", "issue": model.OTHER_ISSUE})
    )


def replay(members: DataFrame, registry: DataFrame, cross_checks: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """The verdict after each arrival, in the order (captured_at, item_id): one row per item.

    With ``merges`` (``origins.merges``) origins are those of all links among the items so far; an arrival that joins
    sets lowers their number.  Without, they are different (source, author)s, a count of first appearances, where items
    without an author count each.  Facts run in two levels, so a bubble of any size is spread over tasks.
    """
    who = F.when(F.trim(F.col("author")) != "", F.concat_ws("|", "source", F.lower(F.trim(F.col("author")))))
    rows = with_reliability(members, registry)
    if merges is None:
        rows = rows.withColumn("_who", F.coalesce(who, F.concat(F.lit("#"), F.col("item_id").cast("string"))))
        first = rows.groupBy("bubble_id", "_who").agg(F.min_by("item_id", F.struct("captured_at", "item_id")).alias("item_id")).select("item_id", F.lit(1).alias("_new"))
        rows = rows.join(first, "item_id", "left").na.fill(0, ["_new"])
    else:
        rows = rows.join(merges, "item_id", "left").withColumn("_new", 1 - F.coalesce("merged", F.lit(0)))
    placed = (F.col("lat").isNotNull() & F.col("lng").isNotNull()).cast("int")
    order = numbered(rows.select("bubble_id", "dataset_id", "item_id", "captured_at", "reliability", placed.alias("_placed"), "_new"), ["captured_at", "item_id"])
    sofar = running(order, ["bubble_id"], {
        "items": ("sum", F.lit(1)), "origins": ("sum", "_new"), "_best": ("min", "reliability"), "_any": ("max", "_placed"),
    })
    return (
        sofar.withColumns({"reliability": F.coalesce("_best", F.lit("F")), "location": F.when(F.col("_any") > 0, "placed").otherwise("unknown")})
        .join(cross_checks, "bubble_id", "left").na.fill({"cross_check": "no_applicable_layer"})
        .withColumn("credibility", floored(F.col("reliability"), credibility(F.col("location"), F.lit("stated"), F.col("origins"), F.col("cross_check"))))
        .withColumn("alert_worthy", (F.col("location") != "unknown") & (F.col("cross_check") != "inconsistent"))
        .select("bubble_id", "dataset_id", "item_id", F.col("captured_at").alias("at"), "items", "origins", "reliability", "credibility", "alert_worthy")
    )


def transitions(verdicts: DataFrame) -> DataFrame:
    """Verdicts at which the grade moved or the bubble first became worth an alert; those worth one fire."""
    arrival = Window.partitionBy("bubble_id").orderBy("at", "item_id")
    grade = F.concat("reliability", F.col("credibility").cast("string"))
    before = F.lag("to_grade").over(arrival)
    woke = F.col("alert_worthy") & ~F.coalesce(F.lag("alert_worthy").over(arrival), F.lit(False))
    rows = verdicts.withColumn("to_grade", grade).withColumn("from_grade", before).withColumn("_moved", F.col("from_grade").isNull() | (F.col("from_grade") != F.col("to_grade")) | woke)
    return rows.where("_moved").drop("_moved").withColumn("alert_fired", F.col("alert_worthy"))


def alert_feed(events: DataFrame, since: str, limit: int = 100) -> DataFrame:
    return (
        events.where(F.col("alert_fired") & (F.col("at") > F.lit(since).cast("timestamp")))
        .orderBy(F.desc("at"), F.desc("item_id")).limit(min(limit, 200))
    )
