"""The state machines of feeds and traces: streams in many batches, restarted from their checkpoint, equal their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import items
from feedloom.streaming import machines

EVENTS = "feed_id long, event_id long, ts timestamp, kind string, config_id string, ok boolean, item_count int, error string, llm_suggested boolean, cadence string"
START, END = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    r, at, rows = random.Random(5), START, []
    for k in range(240):
        at += dt.timedelta(seconds=r.choice([30, 400, 1500]))
        f = r.randrange(5)
        kind = "dismiss" if r.random() < 0.08 else "refresh"
        ok = r.random() > 0.25
        rows.append((f, k, at, kind, None if f == 4 and k % 2 else f"c{f}", ok, int(r.random() > 0.8), None if ok else "HTTP 500 " + "x" * 600, f != 3, ["15m", "1h", "on_demand", "1d", "whenever"][f]))
    rows += [(9, 900, END, "refresh", None, True, 1, None, False, "1h"), (9, 901, END + dt.timedelta(seconds=1), "refresh", None, True, 1, None, False, "1h")]  # lets the watermark pass all timers
    return spark.createDataFrame(rows, EVENTS)


def in_batches(spark, rows, folder, calls):
    """Feeds the rows to a stream, by time, a file for each micro-batch, over several runs of the job; the last rows of each run come alone."""
    out, ids = None, [r[0] for r in rows.select("event_id").orderBy("ts", "event_id").collect()]
    for part in range(calls["parts"]):
        chosen = ids[part * len(ids) // calls["parts"] : (part + 1) * len(ids) // calls["parts"]]
        rows.where(F.col("event_id").isin(chosen)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if part in calls["runs"]:
            source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            out = machines.run_to_table(spark, calls["machine"](source), folder)
    return out


def test_refresh_machine(spark, events, tmp_path):
    got = in_batches(spark, events, str(tmp_path), {"machine": machines.refresh_machine, "parts": 6, "runs": {2, 5}})
    want = items.refresh_machine_rows(events, F.lit(END))
    assert sorted(map(str, got.where("feed_id < 9").collect())) == sorted(map(str, want.where("feed_id < 9").select(*got.columns).collect()))
    kinds = {r["kind"]: r["n"] for r in want.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert {"ok", "failed", "skipped", "due"} <= set(kinds)
    assert want.where("triggered").groupBy("feed_id").count().agg(F.max("count")).first()[0] > 1  # a dismissal lets it trigger again
    assert want.where("missed").count() and want.where("length(error) = 500").count()


def test_refresh_rules_by_hand(spark):
    t = lambda m: START + dt.timedelta(minutes=m)
    row = lambda k, m, kind="refresh", ok=True, n=0: (1, k, t(m), kind, "c", ok, n, None if ok else "e", True, "15m")
    log = spark.createDataFrame([row(0, 0), row(1, 10), row(2, 20, ok=False), row(3, 30), row(4, 31), row(5, 32, "dismiss"), row(6, 60), row(7, 61, n=2)], EVENTS)
    got = {r["event_id"]: r for r in items.refresh_machine_rows(log, F.lit(t(70))).collect() if r["event_id"] is not None}
    assert [got[k]["streak"] for k in (0, 1, 2, 3, 4, 6, 7)] == [1, 2, 2, 3, 4, 5, 0]
    assert [k for k in got if got[k]["triggered"]] == [3, 6] and [k for k in got if got[k]["missed"]] == [6]
    due = sorted(r["at"] for r in items.refresh_machine_rows(log, F.lit(t(70))).where("kind = 'due'").collect())
    assert due == [t(46)]


def test_trace_machine(spark, tmp_path):
    r, at, rows = random.Random(8), START, []
    for k in range(500):
        at += dt.timedelta(seconds=r.choice([5, 60, 900, 5000]) if k % 50 else 9000)
        rows.append((0 if r.random() < 0.6 else r.randrange(1, 6), k, at))
    rows += [(9, 900, END), (9, 901, END + dt.timedelta(seconds=1))]
    df = spark.createDataFrame(rows, "trace_id long, event_id long, ts timestamp")
    got = in_batches(spark, df, str(tmp_path), {"machine": lambda s: machines.trace_machine(s, most=7), "parts": 5, "runs": {1, 4}})
    want = items.trace_sessions(df, most=7).where("trace_id < 9")
    assert sorted(map(str, got.where("trace_id < 9").collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert want.where("n > 7").count() and want.where("session > 0").count()
