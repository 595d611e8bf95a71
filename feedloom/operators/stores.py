"""Keyed stores (configs, feeds, settings, caches) as tables: reading, migration, upsert, deletion, forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from .items import keep_first, unexpired

SAFE_ID = r"^[A-Za-z0-9_\-]{1,64}$"
#: What a saved feed has where it says nothing, by type; source_url falls back to feed_url.
FEED_DEFAULTS = {
    "cadence": ("string", "1d"), "fetch_backend_override": ("string", ""), "stealth": ("boolean", False), "solve_cloudflare": ("boolean", False), "llm_suggested": ("boolean", False),
    "last_refresh_at": ("string", None), "last_refresh_ok": ("boolean", None), "last_error": ("string", ""), "cached_atom_path": ("string", ""), "consecutive_empty_refreshes": ("int", 0),
    "pending_llm_update": ("string", None), "feed_url": ("string", ""), "strategy": ("string", "rss"), "name": ("string", "Untitled Feed"),
}


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON-lines files; broken lines are left out, a missing folder is an error of the reader."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def migrate_feeds(feeds: DataFrame) -> DataFrame:
    """Defaults for missing values, old strategy names replaced; rows without a valid id, strategy or cadence go."""
    have = lambda n, kind: F.col(n) if n in feeds.columns else F.lit(None).cast(kind)
    filled = {n: F.coalesce(have(n, kind), F.lit(v).cast(kind)) for n, (kind, v) in FEED_DEFAULTS.items()}
    filled["source_url"] = F.coalesce(have("source_url", "string"), filled["feed_url"])
    out = feeds.withColumns(filled).withColumn("strategy", F.when(F.col("strategy").isin("json", "json-api"), "json_api").otherwise(F.col("strategy")))
    return out.where(F.col("feed_id").cast("string").rlike(SAFE_ID) & F.col("strategy").isin(L.STRATEGIES) & F.col("cadence").isin("on_demand", *L.CADENCE_SECONDS))


def upsert(store: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """store with the last change of each key in place of its row; changes with an unsafe key are left out."""
    last = keep_first(changes.where(F.col(key).cast("string").rlike(SAFE_ID)), [key], [F.desc(order)]).drop(order)
    return store.join(last, key, "left_anti").unionByName(last)


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys, key, "left_anti")


def fold_example(many: Column, one: Column) -> Column:
    """A single example joins the list of examples, once."""
    blank = F.coalesce(F.trim(one), F.lit("")) == ""
    return F.when(blank, many).when(F.size(many) == 0, F.array(one)).when(~F.array_contains(many, one), F.array_append(many, one)).otherwise(many)


def form_number(text: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(text.try_cast("int"), F.lit(default))))


def example_rows(form: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, row, field, value): the n-th values of the fields' lists form row n; blanks and empty rows go."""
    zipped = F.arrays_zip(*[F.col(f) for f in fields])
    rows = form.select(by, F.posexplode(zipped).alias("row", "z"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col("z")[f]).alias("value")) for f in fields]))
    return rows.select(by, "row", cells.alias("c")).select(by, "row", "c.field", "c.value").where("value is not null and value <> ''")


def parsed_store(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """The documents of JSON lines; lines that are no JSON are left out."""
    return lines.where(F.try_parse_json(line).isNotNull()).select(F.from_json(line, schema).alias("d")).select("d.*")


def is_safe_id(c: Column, longest: int = 64) -> Column:
    """Letters, digits, _ and - only, so that an id can stand in a path."""
    return c.rlike(rf"^[A-Za-z0-9_\-]{{1,{longest}}}$")


def update_settings(now: DataFrame, changes: DataFrame, known: list[str], by: list[str]) -> DataFrame:
    """Settings (by, name, value) with changes of known names laid over them."""
    last = changes.where(F.col("name").isin(known))
    return now.join(last, [*by, "name"], "left_anti").unionByName(last)


def service_url(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def store_cache(cache: DataFrame, new: DataFrame, key: str, at: str, now: Column, ttl_s: int, order: str) -> DataFrame:
    """The cache without expired entries, with the newest of each key."""
    return keep_first(unexpired(cache.unionByName(new), at, now, ttl_s), [key], [F.desc(order)])


def flat_recipe(strategy: Column, selectors: Column, method: Column) -> Column:
    """The selectors of a config as a flat map under the names that its strategy's form uses; the item's comes first."""
    of = lambda k: F.coalesce(selectors[k], F.lit(""))
    named = lambda item, form: F.map_from_entries(F.array(F.struct(F.lit(item), of("item")), *[F.struct(F.lit(form.format(r)), of(f"item_{r}")) for r in ("title", "link", "content", "timestamp")]))
    request = F.create_map(F.lit("method"), F.coalesce(F.nullif(method, F.lit("")), F.lit("GET")))
    return F.when(strategy == "json_api", F.map_concat(named("item_path", "item_{}"), request)).when(strategy == "xpath", named("item_selector", "{}_selector")).when(strategy == "embedded_json", named("path", "item_{}"))


def overlay(configs: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """configs with the columns of their overrides where these are neither null nor empty."""
    o = overrides.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = configs.join(o, key, "left")
    said = lambda c: F.when(F.col(f"__{c}").cast("string") != "", F.col(f"__{c}"))
    return out.withColumns({c: F.coalesce(said(c), F.col(c)) for c in columns}).select(*configs.columns)
