"""The entry points: discover, scrape, preview, refresh, export; each over whole relations of pages, responses or configs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import lexicons as L
from .functions.json_walk import best_place, dot_get
from .functions.scalars import is_graphql
from .operators import anchors, candidates, export, items, xpath
from .sources import documents
from .sources.dom import nodes, shared
from .sources.written import large, written

ITEM = ["config_id", "ord", *items.FIELDS]
FIELD_PATHS = "map<string,string>"


def discover(pages: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """(page_id, kind, selector, score, item_count): candidates of every kind found in pages (page_id, url, html) and in
    captures (page_id, ord, method, url, status, content_type, body, request_body)."""
    pages = written(pages.select("page_id", "url", "html"))  # made once for all kinds
    n = shared(nodes(pages, *candidates.PARSER_COLUMNS, tags=[*L.ITEM_TAGS, *L.LOW_VALUE_ANCESTORS]))
    found = [
        documents.embedded_candidates(pages, "page_id").select("page_id", F.lit("embedded_json").alias("kind"), F.concat_ws(" ", "label", "path").alias("selector"), "score", F.col("n_items").cast("long").alias("item_count")),
        candidates.merge(candidates.repeated_blocks(n), candidates.parser_candidates(n)).select("page_id", F.lit("xpath").alias("kind"), "selector", F.col("confidence").cast("double").alias("score"), F.col("item_count").cast("long").alias("item_count")),
        anchors.date_anchors(pages).select("page_id", F.lit("date_anchor").alias("kind"), "selector", F.col("confidence").cast("double").alias("score"), F.col("item_count").cast("long").alias("item_count")),
        documents.feed_candidates(pages, "page_id", "url").where("source = 'link'").select("page_id", F.lit("rss").alias("kind"), F.col("feed_url").alias("selector"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("item_count")),
    ]
    if captures is not None:
        wanted = documents.wanted_captures(captures)
        found.append(documents.graphql_operations(wanted, "page_id").select("page_id", F.lit("graphql").alias("kind"), F.concat_ws(" ", "url", "op_name").alias("selector"), "score", F.col("n_items").cast("long").alias("item_count")))
        rest = wanted.where(~is_graphql(F.col("url"), F.col("content_type"), F.col("request_body")))
        found.append(documents.endpoints(rest, ["page_id"]).select("page_id", F.lit("json_api").alias("kind"), F.col("bucket").alias("selector"), F.col("score").cast("double").alias("score"), F.lit(None).cast("long").alias("item_count")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def scrape(configs: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, runs) of configs (config_id, url, strategy, item, fields map, max_items) over responses (url, status, body).

    Strategies: rss (Atom or RSS), json_api and json_dot_notation, embedded_json, graphql, xpath. Runs have one row for each
    config: item_count and error (no response, HTTP status, unsupported strategy, bad selector). A bad row never fails the job.
    All items are read; only those of JSON end at a config's own max_items, where it isn't null.
    """
    c = configs.join(large(responses), "url", "left")
    supported = ["rss", "json_api", "json_dot_notation", "embedded_json", "graphql", "xpath"]
    error = F.when(~F.col("strategy").isin(supported), F.concat(F.lit("unsupported strategy: "), "strategy")).when(F.col("status").isNull(), "no response").when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    c = written(c.withColumn("error", error).withColumn("body", F.when(F.col("error").isNull(), F.col("body"))))  # every strategy reads it
    ok = c.where("error is null")
    feed = ok.where("strategy = 'rss'")
    atom = documents.atom_items(feed.where(F.col("body").contains("<entry")), "config_id", most=None)
    rss = documents.rss_items(feed.where(~F.col("body").contains("<entry")), "config_id", most=None)
    api = ok.where(F.col("strategy").isin("json_api", "json_dot_notation")).select("config_id", "body", "item", "fields", "max_items")
    first = documents.first_embedded(ok.where("strategy = 'embedded_json'"), "config_id", "body").withColumnRenamed("value", "body")
    embedded = ok.select("config_id", "item", "fields", "max_items").join(first, "config_id")
    embedded = embedded.select("config_id", "body", F.when(F.col("item") == "", best_place(F.col("body"))["path"]).otherwise(F.col("item")).alias("item"), "fields", "max_items")
    graphql = ok.where("strategy = 'graphql'").select("config_id", "body", documents.unwrapped(F.col("body"), F.col("item")).alias("item"), "fields", "max_items")
    api = api.unionByName(graphql)
    raw = documents.json_items(api.unionByName(embedded), ["config_id", "fields", "max_items"], F.col("item"), most=None).where("max_items is null or ord < max_items")
    for name in items.FIELDS:
        raw = raw.withColumn(name, F.coalesce(dot_get(F.col("raw"), F.coalesce(F.col("fields")[name], F.lit("?"))), F.lit("")))
    page = ok.where("strategy = 'xpath'").withColumn("x", xpath.extract_every_item(F.col("body"), F.col("item"), F.to_json("fields"), F.col("url")))
    dom = page.select("config_id", F.explode("x.items").alias("i")).select("config_id", "i.*")
    found = atom.select(*ITEM).unionByName(rss.select(*ITEM)).unionByName(raw.select(*ITEM)).unionByName(dom.select(*ITEM))
    bad = page.where("x.error is not null").select("config_id", F.col("x.error").alias("x_error"))
    counts = found.groupBy("config_id").agg(F.count("*").alias("n"))
    runs = c.select("config_id", "strategy", "error").join(counts, "config_id", "left").join(bad, "config_id", "left")
    return found, runs.select("config_id", "strategy", F.coalesce("n", F.lit(0)).alias("item_count"), F.coalesce("error", "x_error").alias("error"))


def preview(found: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """The first items of each config, and in how many of them each field is filled."""
    return items.first_n(found, ["config_id"], ["ord"], most), items.coverage(found, ["config_id"], most)


def refresh(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streaks after each refresh, and the refreshes that trigger a new analysis."""
    states = items.refresh_states(log)
    return states, items.drift_triggers(states)


def export_atom(found: DataFrame, titles: DataFrame, now: Column | None = None) -> DataFrame:
    """(config_id, document): an Atom document for each config of titles (config_id, name, url), as of ``now``."""
    entries = export.atom_entries(found, "config_id", updated=now)
    return export.atom_documents(entries.join(titles, "config_id"), "config_id", "name", "url", now)
