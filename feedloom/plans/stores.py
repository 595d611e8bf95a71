"""Queries of the versioned stores: what each version holds after writes, changes and deletions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export, stores
from ..sources.versioned import KeyedStore, config_rows
from ..sources.written import shared_folder
from . import render as R
from .queries import query
from .render import table


def _store(spark: SparkSession, key: str, schema: str) -> KeyedStore:
    return KeyedStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", key, schema)


@query("""SELECT 1 AS version, c_custkey::VARCHAR AS config_id, c_name AS name, c_custkey::VARCHAR AS cache_key FROM customer
  UNION ALL SELECT 2, c_custkey::VARCHAR, CASE WHEN c_custkey % 5 = 0 THEN 'second of ' || c_name ELSE c_name END, c_custkey::VARCHAR FROM customer
  UNION ALL SELECT 3, c_custkey::VARCHAR, CASE WHEN c_custkey % 5 = 0 THEN 'second of ' || c_name ELSE c_name END, c_custkey::VARCHAR FROM customer WHERE c_custkey % 7 <> 0""")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """Configs written, changed twice at once (the last counts) and deleted: every version can still be read; unsafe ids are never stored."""
    s = _store(spark, "config_id", "config_id string, name string, cache_key string")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("config_id"), F.col("c_name").alias("name"), F.lit(0).alias("at"))
    s.upsert(config_rows(c.union(c.select(F.concat(F.lit("../"), "config_id"), "name", "at"))), "at")
    fifth = c.where("config_id % 5 = 0").select("config_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), "name")
    s.upsert(config_rows(fifth.withColumn("name", F.concat(F.when(F.col("at") == 1, "first of ").otherwise("second of "), "name"))), "at")
    s.delete(c.where("config_id % 7 = 0"))
    out = s.read(1).withColumn("version", F.lit(1))
    return out.unionByName(s.read(2).withColumn("version", F.lit(2))).unionByName(s.read().withColumn("version", F.lit(3)))


@query("""SELECT o_custkey::VARCHAR AS feed_id, CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE 1 END AS written, CASE WHEN o_custkey % 4 = 0 THEN least(count(*), 3) ELSE count(*) END AS n_entries FROM orders GROUP BY o_custkey""")
def atom_store(spark: SparkSession, d: str) -> DataFrame:
    """Atom documents in a store, some of them written again: readers of the newest version see whole documents only, old or new."""
    from .queries import json_items

    s = _store(spark, "feed_id", "feed_id string, document string, written int")
    items = json_items(spark, d)

    def documents(rows: DataFrame, run: int) -> DataFrame:
        entries = export.atom_entries(rows, "cust").withColumns({"name": F.lit("n"), "url": F.lit("https://x/")})
        return export.atom_documents(entries, "cust", "name", "url", F.lit("2024-01-01").cast("timestamp")).select(F.col("cust").cast("string").alias("feed_id"), "document", F.lit(run).alias("written"))

    s.upsert(documents(items, 1), "written")
    s.upsert(documents(items.where("cust % 4 = 0 and ord < 3"), 2), "written")
    return s.read().select("feed_id", "written", F.regexp_count("document", F.lit("<entry>")).cast("long").alias("n_entries"))


@query("""SELECT c_custkey AS feed_id, CASE WHEN c_custkey % 3 = 0 THEN 'json_api' WHEN c_custkey % 3 = 1 THEN 'rss' ELSE 'xpath' END AS strategy, CASE WHEN c_custkey % 2 = 0 THEN '1h' ELSE '1d' END AS cadence,
  CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'Untitled Feed' END AS name, '/f/' || c_custkey AS source_url, '/f/' || c_custkey AS feed_url, '' AS fetch_backend_override, c_custkey % 2 = 1 AS stealth, false AS solve_cloudflare, false AS llm_suggested,
  NULL::VARCHAR AS last_refresh_at, NULL::BOOLEAN AS last_refresh_ok, '' AS last_error, '' AS cached_atom_path, (c_custkey % 9)::INT AS consecutive_empty_refreshes, NULL::VARCHAR AS pending_llm_update FROM customer WHERE c_custkey % 13 <> 0""")
def store_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Old rows of feeds with all defaults; a row whose cadence is unknown is dropped."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("feed_id"), F.when(k % 3 == 0, F.when(k % 2 == 0, "json").otherwise("json-api")).when(k % 3 == 2, "xpath").alias("strategy"), F.when(k % 13 == 0, "hourly").when(k % 2 == 0, "1h").alias("cadence"), F.when(k % 4 == 0, F.col("c_name")).alias("name"),
        F.concat(F.lit("/f/"), k.cast("string")).alias("feed_url"), F.when(k % 2 == 1, True).alias("stealth"), (k % 9).cast("int").alias("consecutive_empty_refreshes"),
    )
    return stores.migrate_feeds(rows)
