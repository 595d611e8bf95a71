"""Refresh state in batch and as a stream, stores, exports and the driver's entry."""

import datetime as dt
import random

import pytest

from feedloom.operators import export, items, stores
from feedloom.streaming.refresh_stream import rate_stream, refresh_stream

LOG = "feed_id long, event_id long, ts timestamp, ok boolean, item_count int, llm_suggested boolean"


@pytest.fixture(scope="module")
def log(spark):
    r, at = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(r.randrange(6), k, at + dt.timedelta(minutes=k), r.random() > 0.2, int(r.random() > 0.75), True) for k in range(300)]
    return rows, spark.createDataFrame(rows, LOG)


def test_streaks(log):
    rows, df = log
    got = {(g.feed_id, g.event_id): g.streak for g in items.refresh_states(df).collect()}
    streak = {}
    for f, e, _, ok, n, _ in rows:
        streak[f] = (0 if n else streak.get(f, 0) + 1) if ok else streak.get(f, 0)
        assert got[f, e] == streak[f]


def test_stream_equals_batch(spark, log, tmp_path):
    rows, df = log
    for part in range(3):
        df.where(f"event_id >= {part * 100} and event_id < {part * 100 + 100}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = refresh_stream(source).writeStream.format("memory").queryName("refreshes").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("refreshes").collect()
    batch = items.refresh_states(df)
    assert {(g.feed_id, g.event_id, g.streak) for g in got} == {(g.feed_id, g.event_id, g.streak) for g in batch.collect()}
    assert {(g.feed_id, g.event_id) for g in got if g.triggered} == {(g.feed_id, g.event_id) for g in items.drift_triggers(batch).collect()}


def test_rate_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at + dt.timedelta(seconds=k)) for k in range(40)] + [(2, at), (2, at + dt.timedelta(hours=2))], "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/r")
    q = rate_stream(spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/r")).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.n, r.over_limit) for r in spark.table("rates").collect()} >= {(1, 40, True), (2, 1, False)}


def test_stores(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"feed_id":"a","strategy":"json"}\nbroken {\n{"feed_id":"../x","strategy":"rss"}\n{"feed_id":"b","strategy":"rss","cadence":"1h"}\n')
    got = {r.feed_id: (r.strategy, r.cadence, r.consecutive_empty_refreshes) for r in stores.migrate_feeds(stores.read_store(spark, str(tmp_path / "f.json"), "feed_id string, strategy string, cadence string")).collect()}
    assert got == {"a": ("json_api", "1d", 0), "b": ("rss", "1h", 0)}
    form = spark.createDataFrame([(1, ["A", " ", "C"], ["x", "", ""])], "id int, title array<string>, link array<string>")
    assert {(r.row, r.field, r.value) for r in stores.example_rows(form, "id", ["title", "link"]).collect()} == {(0, "title", "A"), (0, "link", "x"), (2, "title", "C")}


def test_atom(spark):
    rows = [("f", 0, "A & <b>", "https://x/1?a=1&b=2", "<p>c</p>", "Mon, 01 Jan 2024 10:00:00 GMT", "t.png", "Ann"), ("f", 1, "", "", "", "soon", "", "")]
    df = spark.createDataFrame(rows, "feed string, ord int, title string, link string, content string, timestamp string, thumbnail string, author string")
    one, two = (r.entry for r in export.atom_entries(df, "feed").orderBy("ord").collect())
    assert "A &amp; &lt;b&gt;" in one and "<published>2024-01-01T10:00:00Z</published>" in one and "t.png" not in one
    assert "(untitled)" in two and "<published>" not in two and "<id>item:e3b0c44298fc1c14" in two


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
