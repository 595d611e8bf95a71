"""What a person or a model is shown: previews, filters of results, cut texts, prompts; and the checks of a model's replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_walk import reply_json
from ..sources.documents import atom_items
from .items import first_n


def cached_items(cached: DataFrame, by: str, body: str = "body", most: int = 10, longest: int = 400) -> DataFrame:
    """The first entries of cached Atom documents, their content cut; documents without an entry give none."""
    rows = atom_items(cached.where(F.contains(body, F.lit("<entry"))), by, body, most)
    return rows.withColumn("content", F.left("content", F.lit(longest)))


def needs_scrape(cached: DataFrame, body: str = "body") -> DataFrame:
    """Rows whose cached document has no entry: they are scraped anew."""
    return cached.where(~F.coalesce(F.contains(body, F.lit("<entry")), F.lit(False)))


def source_sample(pages: DataFrame, by: str, body: str, most: int = 12_000) -> DataFrame:
    return pages.select(by, F.left(body, F.lit(most)).alias("sample"))


def useful(found: DataFrame) -> DataFrame:
    """Candidates (kind, item_count, score, is_alive) worth showing: live feeds, APIs with three items or a fair score, embedded JSON with three items."""
    kind, n = F.col("kind"), F.col("item_count")
    return found.where(((kind == "rss") & F.col("is_alive")) | ((kind == "api") & ((n >= 3) | (F.col("score") >= 0.3))) | ((kind == "embedded") & (n >= 3)) | ~kind.isin("rss", "api", "embedded"))


def auto_preview(found: DataFrame, by: list[str], order: str, least: float = 0.7, most: int = 3) -> DataFrame:
    """found with auto_preview: the best of each group, and further ones with a good score, three in all."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), order))
    return found.withColumn("__k", rank).withColumn("auto_preview", (F.col("__k") == 1) | ((F.col("score") >= least) & (F.col("__k") <= most))).drop("__k")


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def short_link(url: Column, longest: int = 60, tail: int = 25) -> Column:
    """A long address as its host and its end."""
    return F.when(F.length(url) <= longest, url).otherwise(F.concat(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1), F.lit("…"), F.right(url, F.lit(tail))))


def artifact(text: Column, longest: int = 2 << 20, kept: int = 1 << 20) -> Column:
    """Text of more than ``longest`` bytes is cut to ``kept`` characters."""
    return F.when(F.octet_length(text) > longest, F.left(text, F.lit(kept))).otherwise(text)


def as_json(rows: DataFrame, by: str) -> DataFrame:
    """(by, response): each row's other columns as a JSON document."""
    return rows.select(by, F.to_json(F.struct(*[c for c in rows.columns if c != by])).alias("response"))


def referenced(refs: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """For each reply (by, ref) the first candidate (by, ord, selector) that it names, by either text holding the other; else the first."""
    both = refs.join(candidates, by)
    named = (F.col("ref") != "") & (F.contains("ref", "selector") | F.contains("selector", "ref"))
    return first_n(both.withColumn("__named", F.coalesce(named, F.lit(False))), [by], [F.desc("__named"), "ord"], 1).drop("__named")


def trimmed_sample(item: Column, keys: int = 10, longest: int = 200) -> Column:
    """A sample item for display, as a map of its first members: long texts are cut, containers are shown by their size."""
    members = F.slice(F.map_entries(F.from_json(item, "map<string,string>")), 1, keys)
    raw = lambda v: F.ltrim(v)
    shown = lambda v: F.when(raw(v).startswith("["), F.concat(F.lit("<list len="), F.json_array_length(v).cast("string"), F.lit(">"))).when(raw(v).startswith("{"), F.concat(F.lit("<dict len="), F.size(F.json_object_keys(v)).cast("string"), F.lit(">"))).otherwise(cut(v, longest))
    return F.map_from_entries(F.transform(members, lambda m: F.struct(m["key"], shown(m["value"]))))


# ---- prompts and replies ----


def prompt(task: str, parts: dict[str, Column], ending: str) -> Column:
    """A prompt: the task, a line for each part, and what to reply."""
    return F.concat_ws("\n", F.lit(task), *[F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("none"))) for name, c in parts.items()], F.lit(ending))


def summaries(found: DataFrame, by: str, order: list, line: str = "line", most: int = 3, longest: int = 3_000) -> DataFrame:
    """(by, summary): the first lines of each group and how many more there are; a long summary is cut."""
    ranked = found.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    lines = F.transform(F.sort_array(F.collect_list(F.when(F.col("__k") <= most, F.struct("__k", line)))), lambda x: x[line])
    g = ranked.groupBy(by).agg(F.array_join(lines, "\n").alias("__t"), F.count("*").alias("__n"))
    more = F.when(F.col("__n") > most, F.concat(F.lit("\n...and "), (F.col("__n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return g.select(by, F.concat(F.left("__t", F.lit(longest)), more).alias("summary"))


def checked_api_map(replies: DataFrame, by: str, text: str = "reply") -> DataFrame:
    """(by, item_path, field_mapping, caveats, error) of replies that map an API's fields; empty mappings go, all values are text."""
    r = replies.withColumn("__t", reply_json(F.col(text))).withColumn("__r", F.from_json("__t", "item_path string, field_mapping map<string,string>, caveats array<string>"))
    kept = F.map_filter(F.col("__r.field_mapping"), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return r.select(by, F.coalesce("__r.item_path", F.lit("")).alias("item_path"), F.coalesce(kept, F.create_map().cast("map<string,string>")).alias("field_mapping"), F.coalesce("__r.caveats", F.array().cast("array<string>")).alias("caveats"), F.when(F.col("__t").isNull(), "reply is not JSON").alias("error"))


def checked_diff(replies: DataFrame, by: str, text: str = "reply") -> DataFrame:
    """(by, diff, headers, error) of replies that change a recipe: scalars as text, headers as a map, lists and objects go."""
    r = replies.withColumn("__t", reply_json(F.col(text))).withColumn("__d", F.from_json(F.get_json_object("__t", "$.diff"), "map<string,string>"))
    scalars = F.map_filter("__d", lambda k, v: v.isNotNull() & ~F.ltrim(v).rlike(r"^[\[{]"))
    empty = F.create_map().cast("map<string,string>")
    headers = F.from_json(F.get_json_object("__t", "$.diff.request_headers"), "map<string,string>")
    return r.select(by, F.coalesce(scalars, empty).alias("diff"), F.coalesce(headers, empty).alias("headers"), F.when(F.col("__t").isNull(), "reply is not JSON").alias("error"))


#: What bridge code must have, calls that are dangerous, and calls to look at.
REQUIRED = {"extends BridgeAbstract": "missing extends BridgeAbstract", "collectData": "missing collectData()", "const NAME": "missing const NAME", "const URI": "missing const URI", "const DESCRIPTION": "missing const DESCRIPTION", "const PARAMETERS": "missing const PARAMETERS"}
DANGEROUS = ["shell_exec", "system(", "passthru(", "popen(", "proc_open(", "eval(", "assert(", "create_function(", "pcntl_exec("]
TO_REVIEW = ["file_get_contents", "fopen(", "curl_", "base64_decode"]


def bridge_warnings(code: Column, name: Column, maintainer: str) -> list[Column]:
    """The columns warnings and notes of generated bridge code, by text alone; nothing is run."""
    lacks = lambda text: ~F.contains(code, F.lit(text))
    found = [F.when(~F.ltrim(code).startswith("<?php"), "code does not start with <?php"), F.when(F.contains(code, F.lit("?>")), "closing tag ?> found"), F.when(~F.contains(code, F.concat(F.lit("class "), name)), F.concat(F.lit("missing class "), name))]
    found += [F.when(lacks(t), message) for t, message in REQUIRED.items()] + [F.when(lacks(f"const MAINTAINER='{maintainer}'") & lacks(f"const MAINTAINER = '{maintainer}'"), "const MAINTAINER differs")]
    found += [F.when(F.contains(code, F.lit(t)), f"dangerous call: {t}") for t in DANGEROUS]
    local = F.when(code.rlike(r"file_get_contents\s*\(\s*[\"'](/|php://)"), "file_get_contents of a local path")
    notes = [F.coalesce(local, F.when(F.contains(code, F.lit(t)), f"{t} present")) if t == "file_get_contents" else F.when(F.contains(code, F.lit(t)), f"{t} present") for t in TO_REVIEW]
    return [F.array_compact(F.array(*found)).alias("warnings"), F.array_compact(F.array(*notes)).alias("notes")]
