"""Queries of the state machines: events as refreshes, dismissals and accesses, in batch and through a stream in several micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import items as I
from ..sources.written import shared_folder
from ..streaming import machines as M
from .queries import CADENCES, query
from .render import table

FILES = 4
#: Rows that a file of a micro-batch holds at least, where there are several; a task writes and reads each.
FILE_ROWS = 250_000


def _feed_events(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("user_id")
    ok = F.col("event_type") != "error"
    return e.select(
        k.alias("feed_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", "dismiss").otherwise("refresh").alias("kind"),
        F.when(k % 7 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("config_id"), ok.alias("ok"), (F.col("event_type") == "purchase").cast("int").alias("item_count"),
        F.when(~ok, F.concat(F.lit("HTTP 500 at "), "event_id")).alias("error"), (k % 2 == 0).alias("llm_suggested"), F.element_at(F.array(*map(F.lit, CADENCES)), (k % 6 + 1).cast("int")).alias("cadence"),
    )


def _accesses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("trace_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


def _streamed(spark: SparkSession, rows: DataFrame, key: str, machine) -> DataFrame:
    """rows through a stream, in ``FILES`` micro-batches in order of time; two more of key -1 let the watermark pass all timers.

    Every micro-batch has as many files as any other, so that a trigger takes just one's; large ones have many.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if low is None:
        rows.write.parquet(f"{folder}/in")
        return spark.createDataFrame([], machine(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).schema)
    place = F.least(F.floor((F.unix_micros("ts") - low) * FILES / (high - low + 1)), F.lit(FILES - 1))
    counts = dict(rows.groupBy(place.cast("int")).count().collect())
    files = max(1, min(counts.get(k, 0) for k in range(FILES)) // FILE_ROWS)
    for k in range(FILES):
        part = rows.where(place == k)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(f"{folder}/in")
    for k in range(2):
        closing = spark.range(0, files, 1, files).select(*[(F.lit(-1) if c == key else F.timestamp_micros(F.lit(high + (k + 1) * 10**14)) if c == "ts" else F.lit("refresh") if c == "kind" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
        closing.write.mode("append").parquet(f"{folder}/in")
    if len(spark.read.schema(rows.schema).parquet(f"{folder}/in").inputFiles()) != files * (FILES + 2):
        raise RuntimeError("a micro-batch has fewer files than another")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    return M.run_to_table(spark, machine(source), folder).where(F.col(key) >= 0)


MACHINE_SQL = """WITH e AS (SELECT user_id AS feed_id, event_id, ts, event_type = 'click' AS dis, user_id % 7 <> 0 AS conf, event_type <> 'error' AS ok, event_type = 'purchase' AS filled, user_id % 2 = 0 AS sug,
  [900, 3600, 21600, 86400, 604800, NULL][user_id % 6 + 1] AS secs FROM events),
g AS (SELECT *, NOT dis AND conf AS ran, NOT dis AND conf AND ok AS good FROM e),
r AS (SELECT *, sum((good AND filled)::INT) OVER w AS run, sum(dis::INT) OVER w AS span FROM g WINDOW w AS (PARTITION BY feed_id ORDER BY ts, event_id)),
s AS (SELECT *, (sum((good AND NOT filled)::INT) OVER (PARTITION BY feed_id, run ORDER BY ts, event_id))::INT AS streak FROM r),
f AS (SELECT feed_id, arg_min(event_id, (ts, event_id)) AS event_id FROM s WHERE good AND streak >= 3 AND sug GROUP BY feed_id, span),
d AS (SELECT feed_id, event_id, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) + secs * 1000 AS due FROM g WHERE ran),
n AS (SELECT *, lag(due) OVER w AS due_before, lead(ms) OVER w AS next FROM d WINDOW w AS (PARTITION BY feed_id ORDER BY ms, event_id))
SELECT s.feed_id, s.event_id, (epoch_us(s.ts) // 1000) AS at_ms, CASE WHEN NOT conf THEN 'skipped' WHEN ok THEN 'ok' ELSE 'failed' END AS kind, CASE WHEN ran AND NOT ok THEN 'HTTP 500 at ' || s.event_id END AS error, streak,
  f.event_id IS NOT NULL AS triggered, coalesce(n.ms > n.due_before + 300000, false) AS missed
FROM s LEFT JOIN f USING (feed_id, event_id) LEFT JOIN n USING (feed_id, event_id) WHERE NOT dis
UNION ALL SELECT feed_id, NULL, due, 'due', NULL, NULL, NULL, NULL FROM n WHERE due IS NOT NULL AND (next IS NULL OR next > due)"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("feed_id", "event_id", F.unix_millis("at").alias("at_ms"), "kind", "error", "streak", "triggered", "missed")


@query(MACHINE_SQL)
def refresh_machine(spark: SparkSession, d: str) -> DataFrame:
    """Refreshes skipped, failed or done, streaks, triggers until dismissed, due times and missed ones."""
    return _shown(I.refresh_machine_rows(_feed_events(spark, d), F.lit("9999-01-01").cast("timestamp")))


@query(MACHINE_SQL)
def refresh_machine_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from the stream's state and timers."""
    return _shown(_streamed(spark, _feed_events(spark, d), "feed_id", M.refresh_machine))


TRACE_SQL = """WITH a AS (SELECT user_id AS trace_id, event_id, ts, CASE WHEN (epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000) > 7200000 THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, (sum(fresh) OVER (PARTITION BY trace_id ORDER BY ts, event_id))::BIGINT AS session FROM a),
b AS (SELECT *, row_number() OVER (PARTITION BY trace_id, session ORDER BY ts DESC, event_id DESC) AS back FROM s)
SELECT trace_id, session, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(max(ts)) // 1000) AS end_ms, count(*) AS n, least(count(*), 2)::INT AS n_kept, arg_max(event_id, back) FILTER (back <= 2) AS oldest_kept FROM b GROUP BY 1, 2"""


def _evicted(rows: DataFrame) -> DataFrame:
    return rows.select("trace_id", "session", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n", "n_kept", "oldest_kept")


@query(TRACE_SQL)
def trace_evictions(spark: SparkSession, d: str) -> DataFrame:
    """What each trace held when its sliding time to live ran out; the last two actions are kept here, as the events are sparse."""
    return _evicted(I.trace_sessions(_accesses(spark, d), most=2))


@query(TRACE_SQL)
def trace_evictions_stream(spark: SparkSession, d: str) -> DataFrame:
    return _evicted(_streamed(spark, _accesses(spark, d), "trace_id", lambda s: M.trace_machine(s, most=2)))
