"""Streams: intake, idempotent redelivery, incremental grouping, alerts on transitions, sweeps, monitors."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from witness.operators import assign, dedupe, origins, store
from witness.sources.item_store import what

KEY = ["dataset_id", "source", "external_id"]


def once(items: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    """First arrivals of a stream.

    Redeliveries within ``delay`` go, and its state is dropped after it: pair this with ``append_new`` against the
    store.  Without a delay the state keeps every key for good, as large as their number, and no store is compared.
    """
    if delay is None:
        return items.dropDuplicates(KEY)
    return items.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(KEY)


def append_new(batch: DataFrame, store_path: str, key: list[str] = KEY) -> DataFrame:
    """Of a micro-batch the items that the stored table doesn't have yet, first arrival of each; they are appended.

    Meant for ``foreachBatch`` with one writer: a batch that is run again finds its rows stored and appends nothing.
    Items without an external id are told apart by their item_id.  ``sources.item_store`` takes several writers.
    The store lies in folders by data set, of which only those of the batch are read, and of these the key columns.
    """
    spark = batch.sparkSession
    own = ["_what" if c == "external_id" else c for c in key]
    rows = dedupe.first_of(batch.withColumn("_what", what()), own, ["captured_at", "item_id"])
    try:
        stored = spark.read.schema(batch.schema).parquet(store_path).withColumn("_what", what())
        here = [r.dataset_id for r in batch.select("dataset_id").distinct().collect()]  # a handful of names
        rows = dedupe.new_items(rows, stored.where(F.col("dataset_id").isin(here)).select(*own), own)
    except AnalysisException as e:  # the first batch finds no table
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows = rows.drop("_what")
    rows.write.mode("append").partitionBy("dataset_id").parquet(store_path)
    return rows


class Grouper(StatefulProcessor):
    """The live bubbles of one (dataset, shard) as state, by the rules of ``assign.LiveBubbles``.

    A bubble goes once the watermark has passed its last report by ``hours``; a timer sees to that where the key gets
    no more rows.
    """

    def __init__(self, threshold: float, metres: float, hours: float, limit: int):
        self.rules = (threshold, metres, hours, limit)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "bubble_id long", "last double, n long, centre array<double>, lat double, lng double, n_geo long")

    def _read(self) -> assign.LiveBubbles:
        found = assign.LiveBubbles(*self.rules)
        for k, v in self.live.iterator():
            found.bubbles[k[0]] = assign.Bubble(v[0], v[1], np.array(v[2], float), *v[3:])
        return found

    def _expire(self, live: assign.LiveBubbles, watermark_ms: int) -> None:
        for k in live.forget(watermark_ms / 1000):
            if self.live.containsKey((k,)):
                self.live.removeKey((k,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if live.bubbles:
            self.handle.registerTimer(int(1000 * (min(b.last for b in live.bubbles.values()) + live.span)) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live, touched, out = self._read(), set(), []
        for r in pd.concat(list(rows)).sort_values(["at", "item_id"]).itertuples(index=False):
            bubble, top = live.place(int(r.item_id), r.at, np.asarray(r.v, float), *assign.place_or_none(r.lat, r.lng))
            touched.add(bubble)
            out.append((r.item_id, bubble, top))
        for k in touched:
            b = live.bubbles[k]
            self.live.updateValue((k,), (b.last, b.n, b.centre.tolist(), b.lat, b.lng, b.n_geo))
        self._expire(live, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["item_id", "bubble_id", "similarity"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._expire(self._read(), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"item_id": pd.Series(dtype="int64"), "bubble_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def group_stream(
    items: DataFrame, threshold: float = assign.THRESHOLD, hours: float = assign.HOURS, shards: list[str] | None = None,
    metres: float = assign.METRES, limit: int = 50, delay: str = "6 hours",
) -> DataFrame:
    """item_id, bubble_id, similarity as items arrive, one state per dataset and ``shards`` columns.

    ``shards`` must be columns across which items never group, such as a coarse region.  An item up to ``delay`` late
    still joins or opens a bubble.  Needs the RocksDB state store.
    """
    rows = items.withWatermark("occurred_at", delay).select(
        "dataset_id", *(shards or []), "item_id", "occurred_at", (F.unix_micros("occurred_at") / 1e6).alias("at"), "lat", "lng", "v"
    )
    return rows.groupBy("dataset_id", *(shards or [])).transformWithStateInPandas(
        Grouper(threshold, metres, hours, limit), "item_id long, bubble_id long, similarity double", "Append", "EventTime"
    )


class Alerts(StatefulProcessor):
    """The previous verdict of each bubble; a row goes out only where it moved."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "grade string, worthy boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        verdicts = pd.concat(list(rows)).sort_values(["at", "item_id"])
        before = self.last.get() if self.last.exists() else None
        grade, worthy = before if before else (None, False)
        out = []
        for r in verdicts.itertuples():
            now = f"{r.reliability}{r.credibility}"
            if now != grade or (r.alert_worthy and not worthy):
                out.append((key[0], r.item_id, grade, now, bool(r.alert_worthy)))
            grade, worthy = now, bool(r.alert_worthy)
        self.last.update((grade, worthy))
        yield pd.DataFrame(out, columns=["bubble_id", "item_id", "from_grade", "to_grade", "alert_fired"])

    def close(self) -> None:
        pass


def alert_stream(verdicts: DataFrame) -> DataFrame:
    """bubble_id, item_id, from_grade, to_grade, alert_fired on each transition of a stream of verdicts."""
    return verdicts.groupBy("bubble_id").transformWithStateInPandas(
        Alerts(), "bubble_id string, item_id long, from_grade string, to_grade string, alert_fired boolean", "Append", "None"
    )


def prefix(tokens: list[str], least: float) -> list[str]:
    """Of a set's tokens in an order that all sets share those of which two sets with a Jaccard overlap of ``least`` must
    have one in common."""
    n = len(tokens)
    return sorted(tokens, key=lambda t: (crc32(t.encode()), t))[: n - ceil(n * least - 1e-9) + 1] if n else []


class Witnesses(StatefulProcessor):
    """What a bubble's verdict follows from, item by item: sets of linked items as a forest of parents, the tokens of each
    item and where they occur, addresses and who quotes them, authors, and the facts of the last verdict."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        table = lambda name, key, value: handle.getMapState(name, key, value, self.ttl_ms)
        self.parents = handle.getMapState("parents", "item_id long", "parent long")
        self.words = table("words", "item_id long", "tokens array<string>")
        self.postings = table("postings", "token string", "items array<long>")
        self.addresses = table("addresses", "url string", "items array<long>")
        self.quotes = table("quotes", "url string", "items array<long>")
        self.authors = table("authors", "who string", "item_id long")
        self.facts = handle.getValueState("facts", "items long, origins long, best string, placed boolean, grade string, worthy boolean")

    @staticmethod
    def _get(state, key, default):
        return state.getValue((key,))[0] if state.containsKey((key,)) else default

    def _find(self, k: int) -> int:
        path = []
        while (up := self._get(self.parents, k, k)) != k:
            path.append(k)
            k = up
        for x in path:
            self.parents.updateValue((x,), (k,))
        return k

    def _linked(self, r) -> Iterator[int]:
        """Earlier items that share this one's wording, address or author; the item is entered on the way."""
        tokens = set(r.tokens)
        near = {k for t in prefix(list(tokens), origins.SAME_WORDING) for k in self._get(self.postings, t, [])}
        for k in near:
            other = set(self._get(self.words, k, []))
            if other and len(tokens & other) / len(tokens | other) >= origins.SAME_WORDING:
                yield k
        for t in prefix(list(tokens), origins.SAME_WORDING):
            self.postings.updateValue((t,), ([*self._get(self.postings, t, []), r.item_id],))
        if tokens:
            self.words.updateValue((r.item_id,), (sorted(tokens),))
        for q in set(r.quoted):
            yield from self._get(self.addresses, q, [])
            self.quotes.updateValue((q,), ([*self._get(self.quotes, q, []), r.item_id],))
        if r.url is not None:
            yield from self._get(self.quotes, r.url, [])
            self.addresses.updateValue((r.url,), ([*self._get(self.addresses, r.url, []), r.item_id],))
        if r.who is not None:
            if self.authors.containsKey((r.who,)):
                yield self._get(self.authors, r.who, None)
            else:
                self.authors.updateValue((r.who,), (r.item_id,))

    def _take(self, key, rows: pd.DataFrame) -> list[tuple]:
        n, found, best, placed, grade, worthy = self.facts.get() if self.facts.exists() else (0, 0, "F", False, None, False)
        out = []
        for r in rows.sort_values(["captured_at", "item_id"]).itertuples(index=False):
            self.parents.updateValue((r.item_id,), (r.item_id,))
            n, found = n + 1, found + 1
            for k in self._linked(r):
                a, b = self._find(r.item_id), self._find(k)
                if a != b:
                    self.parents.updateValue((max(a, b),), (min(a, b),))
                    found -= 1
            best = min(best, r.reliability) if isinstance(r.reliability, str) else best
            placed = placed or bool(r.placed)
            now = f"{best}{_credibility(placed, found, r.cross_check, best)}"
            up = placed and r.cross_check != "inconsistent"
            if now != grade or (up and not worthy):
                out.append((key[0], r.item_id, grade, now, up, n, found))
            grade, worthy = now, up
        self.facts.update((n, found, best, placed, grade, worthy))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._take(key, pd.concat(list(rows))), columns=[c.split()[0] for c in _TRANSITION.split(", ")])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._take(key, initialState)

    def close(self) -> None:
        pass


_TRANSITION = "bubble_id string, item_id long, from_grade string, to_grade string, alert_fired boolean, items long, origins long"


def _credibility(placed: bool, n_origins: int, cross: str, best: str) -> int:
    """The rule table of ``grade.credibility`` and its floor, for items whose time is known."""
    if not placed:
        return 6
    if cross == "inconsistent":
        return 5
    c = 4 - (n_origins >= 2) - (cross == "consistent")
    return 3 if c == 4 and best == "A" else c


def witness_stream(
    items: DataFrame, registry: DataFrame, cross_checks: DataFrame, known: DataFrame | None = None, ttl: timedelta | None = None
) -> DataFrame:
    """Grade transitions of bubbles as their items arrive: bubble_id, item_id, from_grade, to_grade, alert_fired, items,
    origins; the same as ``grade.transitions`` over ``grade.replay`` with ``origins.merges``.

    ``known`` are members that the store has already: state begins with them and they raise no row.  Items of a batch are
    taken by (captured_at, item_id), so batches must come in that order.  With ``ttl`` an item links to those entered
    within it only, and state of items goes after it; without, state grows with a bubble.  Needs the RocksDB state store.
    """

    def rows(df: DataFrame) -> DataFrame:
        who = F.when(F.trim(F.col("author")) != "", F.concat_ws("|", "source", F.lower(F.trim(F.col("author")))))
        told = store.with_reliability(df, registry).join(cross_checks.select("bubble_id", "cross_check"), "bubble_id", "left")
        return told.select(
            "bubble_id", "item_id", "captured_at", "reliability", (F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("placed"), who.alias("who"),
            F.coalesce("cross_check", F.lit("no_applicable_layer")).alias("cross_check"), origins.tokens(F.col("text")).alias("tokens"), origins.plain_url(F.col("url")).alias("url"),
            F.transform(F.coalesce("quoted_urls", F.array().cast("array<string>")), origins.plain_url).alias("quoted"),
        )

    begin = rows(known).groupBy("bubble_id") if known is not None else None
    return rows(items).groupBy("bubble_id").transformWithStateInPandas(
        Witnesses(int(ttl.total_seconds() * 1000) if ttl else None), _TRANSITION, "Append", "ProcessingTime" if ttl else "None", begin
    )


def sweep(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """Items of a batch that intake couldn't place in a bubble."""
    return store.pending(batch, edges)


def tumbling_counts(items: DataFrame, width: str = "1 hour", delay: str | None = "6 hours") -> DataFrame:
    """dataset_id, start, n: reports per window of event time."""
    rows = items.withWatermark("occurred_at", delay) if delay and items.isStreaming else items
    return rows.groupBy("dataset_id", F.window("occurred_at", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("dataset_id", F.col("w.start").alias("start"), "n")
