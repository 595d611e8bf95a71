"""State machines of feeds and traces as Structured Streaming jobs with named states and timers.

refresh_machine() keeps a feed's streak, pending recommendation and due time; operators.items.refresh_machine_rows is its
batch twin. trace_machine() keeps the last actions of a trace while it is used; operators.items.trace_sessions is its batch twin.
A key has one state value, read and written once for each micro-batch (each call is a message to the JVM); states live in the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import lexicons as L

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FEED_INPUT = ["feed_id", "event_id", "kind", "config_id", "ok", "item_count", "error", "llm_suggested", "cadence"]
FEED_OUTPUT = "feed_id long, event_id long, at long, kind string, error string, streak int, triggered boolean, missed boolean"
TRACE_OUTPUT = "trace_id long, session long, start long, end long, n long, n_kept int, oldest_kept long"
FEED_ROW, TRACE_ROW = (Row(*[c.split()[0] for c in schema.split(", ")]) for schema in (FEED_OUTPUT, TRACE_OUTPUT))


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """A key's rows of a micro-batch by time and event."""
    return sorted(rows, key=lambda x: (x.us, x.event_id is None, x.event_id or 0))


def _timed(events: DataFrame, columns: list[str], delay: str) -> DataFrame:
    """events with their time as microseconds since 1970 too: states and rows carry these, so no time zone plays a part."""
    return events.select(*columns, "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)


class FeedMachine(StatefulProcessor):
    """One feed: a refresh is skipped, fails or succeeds; a dismissal ends what is pending; a timer tells that the feed is due."""

    def __init__(self, grace_s: int, least: int) -> None:
        self.grace_ms, self.least = grace_s * 1000, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", "streak int, pending long, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        streak, since, due = self.feed.get() or (0, None, None)
        was_due = due
        for x in _in_order(rows):
            if x.kind == "dismiss":
                since = None
                continue
            if x.config_id is None:
                yield FEED_ROW(key[0], x.event_id, x.us, "skipped", None, streak, False, False)
                continue
            now, missed = x.us // 1000, False
            if due is not None and now > due:  # before a timer could tell it
                yield FEED_ROW(key[0], None, due * 1000, "due", None, None, None, None)
                missed = now > due + self.grace_ms
            triggered = False
            if x.ok:
                streak = 0 if (x.item_count or 0) > 0 else streak + 1
                triggered = bool(streak >= self.least and x.llm_suggested and since is None)
                since = x.us if triggered else since
            seconds = L.CADENCE_SECONDS.get(x.cadence)
            due = now + seconds * 1000 if seconds else None
            error = None if x.ok else (x.error or "")[:500]
            yield FEED_ROW(key[0], x.event_id, x.us, "ok" if x.ok else "failed", error, streak, triggered, missed)
        self.feed.update((streak, since, due))
        if was_due != due:
            if was_due is not None:
                self.handle.deleteTimer(was_due)
            if due is not None:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        streak, since, due = self.feed.get() or (0, None, None)
        if due is not None and due == expiredTimerInfo.getExpiryTimeInMs():
            self.feed.update((streak, since, None))
            yield FEED_ROW(key[0], None, due * 1000, "due", None, None, None, None)

    def close(self) -> None:
        pass


def refresh_machine(events: DataFrame, grace_s: int = 300, least: int = 3, delay: str = "0 seconds") -> DataFrame:
    """One row per refresh of the stream and one each time that a feed falls due without one.

    ``events`` has refreshes and dismissals: feed_id, event_id, ts, kind (``refresh`` or ``dismiss``), config_id, ok,
    item_count, error, llm_suggested, cadence. A refresh without a config is skipped and changes nothing, a failed one keeps
    the streak, an empty one adds to it. A streak of ``least`` of a suggested feed triggers an analysis, once until it is
    dismissed. ``due`` rows come a cadence after the last refresh (failed ones count); a refresh later than ``grace_s`` after
    that is ``missed``. Unknown cadences and on_demand are never due. Events of a feed arrive in order over micro-batches.
    """
    timed = _timed(events, FEED_INPUT, delay)
    out = timed.groupBy("feed_id").transformWithState(statefulProcessor=FeedMachine(grace_s, least), outputStructType=FEED_OUTPUT, outputMode="Append", timeMode="EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


class TraceMachine(StatefulProcessor):
    """One trace: its last actions, kept while each access comes within the time to live of the one before."""

    def __init__(self, ttl_s: int, most: int) -> None:
        self.ttl_ms, self.most = ttl_s * 1000, most

    def expiry(self, end: int) -> int:
        return int(end) // 1000 + self.ttl_ms + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "session long, start long, end long, n long, kept array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session, start, end, n, kept = self.span.get() or (-1, None, None, 0, [])
        kept, armed = [*(kept or [])], self.expiry(end) if n else None
        for x in _in_order(rows):
            if n and x.us // 1000 - end // 1000 > self.ttl_ms:
                yield TRACE_ROW(key[0], session, start, end, n, len(kept), kept[0])
                n, kept = 0, []
            if not n:
                session, start = session + 1, x.us
            end, n = x.us, n + 1
            kept = [*kept, x.event_id][-self.most :]
        self.span.update((session, start, end, n, kept))
        if armed is not None:
            self.handle.deleteTimer(armed)
        self.handle.registerTimer(self.expiry(end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        session, start, end, n, kept = self.span.get()
        self.span.update((session, start, end, 0, []))
        if n:
            yield TRACE_ROW(key[0], session, start, end, n, len(kept), kept[0])

    def close(self) -> None:
        pass


def trace_machine(actions: DataFrame, ttl_s: int = 7_200, most: int = 60, delay: str = "0 seconds") -> DataFrame:
    """One row for each eviction: what a trace (trace_id, event_id, ts) held when ``ttl_s`` had passed since its last access.

    Each access renews the time to live; of longer traces the last ``most`` actions are kept. Timers run on event time.
    """
    timed = _timed(actions, ["trace_id", "event_id"], delay)
    out = timed.groupBy("trace_id").transformWithState(statefulProcessor=TraceMachine(ttl_s, most), outputStructType=TRACE_OUTPUT, outputMode="Append", timeMode="EventTime")
    return out.withColumns({"start": F.timestamp_micros("start"), "end": F.timestamp_micros("end")})


def run_to_table(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Everything that the stream has now, through its state and into a table of folder; a later call goes on from the checkpoint there."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
