"""The refresh state machine as a Structured Streaming job; its batch twin is operators.items.refresh_states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "feed_id long, event_id long, ok boolean, streak int, triggered boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    streak, pending = state.get if state.exists else (0, False)
    log = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
    rows = []
    for ok, n, suggested, event in zip(log["ok"], log["item_count"], log["llm_suggested"], log["event_id"], strict=True):
        if ok:
            streak = 0 if n > 0 else streak + 1
        triggered = bool(ok and streak >= 3 and suggested and not pending)
        pending = pending or triggered
        rows.append((key[0], event, bool(ok), streak, triggered))
    state.update((streak, pending))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def refresh_stream(log: DataFrame) -> DataFrame:
    """One row per refresh of the stream (feed_id, event_id, ts, ok, item_count, llm_suggested): the streak after it, and
    whether it triggers a new analysis: a successful refresh with a streak of three or more, once until dismissed.

    State is two values for each feed, kept in the stream's checkpoint. Refreshes of one feed must arrive in order over
    micro-batches; within one they are sorted.
    """
    grouped = log.select("feed_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "ok", "item_count", "llm_suggested").groupBy("feed_id")
    return grouped.applyInPandasWithState(_step, OUTPUT, "streak int, pending boolean", "append", GroupStateTimeout.NoTimeout)


def rate_stream(requests: DataFrame, limit: int = 30) -> DataFrame:
    """Requests of each user in each minute, with late data up to ten minutes, and whether they exceed the limit."""
    timed = requests.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "10 minutes")
    g = timed.groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("minute"), "n", (F.col("n") > limit).alias("over_limit"))
