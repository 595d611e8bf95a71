"""Operators on items, feeds and run logs: caps, coverage, deduplication, joins, refresh state, time to live, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.json_walk import reply_json

FIELDS = ["title", "link", "content", "timestamp", "thumbnail", "author"]


def first_n(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return first_n(rows, key, order, 1)


def coverage(items: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """Over the first items of each group: how many there are and in how many each field is filled."""
    return items.where(F.col("ord") < most).groupBy(*by).agg(F.count("*").alias("n_items"), *[F.count_if(F.col(c) != "").alias(f"n_{c}") for c in FIELDS if c in items.columns])


def feeds_with_configs(feeds: DataFrame, configs: DataFrame) -> DataFrame:
    """Every feed with its config; error where it names none or one that is missing."""
    c = configs.withColumn("__there", F.lit(True))
    out = feeds.join(c, "config_id", "left")
    return out.withColumn("error", F.when(F.col("config_id").isNull(), "no config").when(F.col("__there").isNull(), "config not found")).drop("__there")


def refresh_states(log: DataFrame, feed: str = "feed_id", order: str = "ts") -> DataFrame:
    """The log (feed, ts, ok, item_count) with the streak of empty refreshes after each one.

    A refresh with items resets the streak, an empty one adds 1, a failed one leaves it as it is.
    """
    w = Window.partitionBy(feed).orderBy(order)
    reset = F.sum((F.col("ok") & (F.col("item_count") > 0)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = log.withColumn("__run", reset)
    empty = (F.col("ok") & (F.col("item_count") == 0)).cast("int")
    return rows.withColumn("streak", F.sum(empty).over(Window.partitionBy(feed, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__run")


def drift_triggers(states: DataFrame, feed: str = "feed_id", order: str = "ts", least: int = 3) -> DataFrame:
    """The refreshes that trigger a new analysis: successful ones whose streak reaches ``least``, of feeds that a model suggested.

    While a recommendation is pending none triggers; a row with ``dismissed`` set ends that. The columns llm_suggested and
    dismissed are optional (true and false where they are missing).
    """
    suggested = F.col("llm_suggested") if "llm_suggested" in states.columns else F.lit(True)
    dismissed = F.coalesce(F.col("dismissed"), F.lit(False)) if "dismissed" in states.columns else F.lit(False)
    spans = states.withColumn("__span", F.sum(dismissed.cast("int")).over(Window.partitionBy(feed).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return keep_first(spans.where(F.col("ok") & (F.col("streak") >= least) & suggested), [feed, "__span"], [order]).drop("__span")


def refresh_outcomes(feeds: DataFrame, configs: DataFrame, runs: DataFrame) -> DataFrame:
    """(feed_id, outcome, error, item_count) of a refresh: skipped without a config, failed where it is missing or its run failed."""
    c = configs.select("config_id", F.lit(True).alias("__there"))
    out = feeds.join(c, "config_id", "left").join(runs.select("config_id", "item_count", F.col("error").alias("__error")), "config_id", "left")
    error = F.when(F.col("config_id").isNull(), "no config").when(F.col("__there").isNull(), "config not found").otherwise(F.left("__error", F.lit(500)))
    outcome = F.when(F.col("config_id").isNull(), "skipped").when(error.isNotNull(), "failed").otherwise("ok")
    return out.select("feed_id", outcome.alias("outcome"), error.alias("error"), F.when(outcome == "ok", F.coalesce("item_count", F.lit(0))).alias("item_count"))


def due_feeds(feeds: DataFrame, now: Column, jitter: float = 0.0, grace_s: int | None = None) -> DataFrame:
    """Feeds whose cadence has passed since their last refresh; unknown cadences and on_demand never are.

    ``jitter`` spreads feeds of one cadence by up to that share of it, always the same for a feed. A refresh that is later than
    ``grace_s`` seconds is marked as missed; it is due all the same.
    """
    seconds = F.create_map(*[F.lit(x) for kv in L.CADENCE_SECONDS.items() for x in kv])[F.col("cadence")]
    age = F.unix_timestamp(now) - F.unix_timestamp("last_refresh_at")
    spread = seconds * (1 + jitter * (F.pmod(F.xxhash64("feed_id"), F.lit(1_000)) / 1_000)) if jitter else seconds
    due = feeds.where(seconds.isNotNull() & (F.col("last_refresh_at").isNull() | (age >= spread)))
    return due if grace_s is None else due.withColumn("missed", F.coalesce(age > spread + grace_s, F.lit(False)))


def unexpired(rows: DataFrame, at: str, now: Column, ttl_s: int) -> DataFrame:
    """Rows whose time lies at most ttl_s seconds before now."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    return rows.where(seconds(now) - seconds(F.col(at)) <= ttl_s)


def sliding_sessions(rows: DataFrame, by: str, at: str, ttl_s: int) -> DataFrame:
    """(by, session, start, end, n): a session lasts while each access comes within the time to live of the one before."""
    w = Window.partitionBy(by).orderBy(at)
    seconds = lambda c: c.cast("timestamp").cast("double")
    new = F.coalesce((seconds(F.col(at)) - seconds(F.lag(at).over(w))) > ttl_s, F.lit(False)).cast("int")
    s = rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(by, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def gate(aggregates: DataFrame) -> DataFrame:
    """Adds needs_browser and the strategy that needs no model: live RSS, else exactly one strong API, else null."""
    rss, api, strong = F.col("n_live_rss"), F.col("n_api"), F.col("n_strong_api")
    browser = F.col("forced") | ((rss == 0) & (F.col("has_js") | F.col("anti_bot") | (api == 0)))
    return aggregates.withColumn("needs_browser", browser).withColumn("strategy", F.when(rss > 0, "rss").when((api == 1) & (strong == 1), "json_api"))


def checked_replies(replies: DataFrame, by: str, text: str = "reply") -> DataFrame:
    """Model replies as (by, strategy, confidence, caveats, error): unknown strategies and non-JSON are errors, numbers are clamped.

    A reply with prose around it counts by its first balanced object.
    """
    r = replies.withColumn("__t", reply_json(F.col(text))).withColumn("__r", F.from_json("__t", "strategy string, confidence string, caveats string"))
    known = F.col("__r.strategy").isin(L.STRATEGIES)
    error = F.when(F.col("__t").isNull(), "reply is not JSON").when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown strategy: "), F.coalesce(F.col("__r.strategy"), F.lit(""))))
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("__r.confidence").try_cast("double"), F.lit(0.0))))
    caveats = F.coalesce(F.size(F.from_json("__r.caveats", "array<string>")), F.lit(0))
    return r.select(by, F.when(error.isNull(), F.col("__r.strategy")).alias("strategy"), F.when(error.isNull(), level).alias("confidence"), F.when(error.isNull(), caveats).alias("n_caveats"), error.alias("error"))


def capped_text(c: Column, more: Column, most: int = 3_000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("\n...and "), more.cast("string"), F.lit(" more"))).otherwise(c)


def refresh_machine_rows(events: DataFrame, until: Column, grace_s: int = 300, least: int = 3) -> DataFrame:
    """What streaming.machines.refresh_machine() gives for the same events, in batch; due times up to ``until`` count."""
    order = ["ts", "event_id"]
    own = events.withColumn("ok", F.col("ok") & F.col("config_id").isNotNull() & (F.col("kind") == "refresh")).withColumn("at", F.struct(*order))
    states = refresh_states(own, order="at").withColumn("dismissed", F.col("kind") == "dismiss")
    fired = drift_triggers(states, order="at", least=least).select("feed_id", "event_id", F.lit(True).alias("fired"))
    ran = events.where("kind = 'refresh' and config_id is not null")
    seconds = F.create_map(*[F.lit(x) for kv in L.CADENCE_SECONDS.items() for x in kv])[F.col("cadence")]
    w = Window.partitionBy("feed_id").orderBy(*order)
    due = ran.withColumn("due", F.timestamp_millis(F.unix_millis("ts") + seconds * 1000)).withColumn("due_before", F.lag("due").over(w)).withColumn("next", F.lead("ts").over(w))
    late = due.select("feed_id", "event_id", (F.unix_millis("ts") > F.unix_millis("due_before") + grace_s * 1000).alias("late"))
    rows = states.where("kind = 'refresh'").join(fired, ["feed_id", "event_id"], "left").join(late, ["feed_id", "event_id"], "left")
    kind = F.when(F.col("config_id").isNull(), "skipped").when(F.col("ok"), "ok").otherwise("failed")
    no = F.lit(False)
    out = rows.select("feed_id", "event_id", F.col("ts").alias("at"), kind.alias("kind"), F.when(kind == "failed", F.left(F.coalesce("error", F.lit("")), F.lit(500))).alias("error"), "streak", F.coalesce("fired", no).alias("triggered"), F.coalesce("late", no).alias("missed"))
    passed = due.where(F.when(F.col("next").isNotNull(), F.unix_millis("next") > F.unix_millis("due")).otherwise(F.col("due") <= until))
    nothing = lambda kind: F.lit(None).cast(kind)
    return out.unionByName(passed.select("feed_id", nothing("long").alias("event_id"), F.col("due").alias("at"), F.lit("due").alias("kind"), nothing("string").alias("error"), nothing("int").alias("streak"), nothing("boolean").alias("triggered"), nothing("boolean").alias("missed")))


def trace_sessions(actions: DataFrame, ttl_s: int = 7_200, most: int = 60) -> DataFrame:
    """(trace_id, session, start, end, n, n_kept, oldest_kept): sliding_sessions() with what is kept of each, the last ``most`` actions."""
    w = Window.partitionBy("trace_id").orderBy("ts", "event_id")
    fresh = F.coalesce(F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w)) > ttl_s * 1000, F.lit(False)).cast("int")
    s = actions.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("back", F.row_number().over(Window.partitionBy("trace_id", "session").orderBy(F.desc("ts"), F.desc("event_id"))))
    return s.groupBy("trace_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.least(F.count("*"), F.lit(most)).cast("int").alias("n_kept"), F.max_by("event_id", F.when(F.col("back") <= most, F.col("back"))).alias("oldest_kept"))
