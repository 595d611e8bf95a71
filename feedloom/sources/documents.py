"""Scans: feeds, JSON APIs, embedded JSON, GraphQL, HAR and captures, scripts, feed links; each over a relation of responses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.json_walk import best_place, dot_get, feed_score, items_at, loads
from ..functions.udf import arrow_udf
from ..functions.scalars import bucket_key, content_type, feed_type, is_api_like, is_graphql, join_url, operation_name, operation_type
from .written import large

ATOM = (
    "entry array<struct<title string, id string, updated string, published string, summary string, content string,"
    " author struct<name string>, link array<struct<_href string, _rel string>>>>"
)
RSS_ITEM = "array<struct<title string, link string, description string, pubDate string, author string, `content:encoded` string, `dc:creator` string, `dc:date` string>>"
RSS = f"channel struct<item {RSS_ITEM}>, item {RSS_ITEM}"


def _first_text(*names: str) -> Column:
    return F.coalesce(*[F.when(F.length(F.trim(x)) > 0, F.trim(x)) for x in map(F.col, names)], F.lit(""))


def _first(rows: Column, most: int | None) -> Column:
    return rows if most is None else F.slice(rows, 1, most)


def atom_items(responses: DataFrame, by: str, body: str = "body", most: int | None = 100) -> DataFrame:
    """The first ``most`` entries (None: all) of Atom bodies; content falls back to the summary, published to updated; the link is the alternate one."""
    e = responses.select(by, F.posexplode(_first(F.from_xml(body, ATOM)["entry"], most)).alias("ord", "e"))
    alternate = F.get(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    return e.select(by, "ord", _first_text("e.title").alias("title"), F.coalesce(alternate, F.lit("")).alias("link"), _first_text("e.content", "e.summary").alias("content"), _first_text("e.published", "e.updated").alias("timestamp"), F.lit("").alias("thumbnail"), _first_text("e.author.name").alias("author"))


def rss_items(responses: DataFrame, by: str, body: str = "body", most: int | None = 100) -> DataFrame:
    """The first ``most`` items (None: all) of RSS 0.9 to 2.0 bodies (RDF items stand beside their channel), with the usual module elements."""
    feed = F.from_xml(body, RSS)
    e = responses.select(by, F.posexplode(_first(F.coalesce(feed["channel"]["item"], feed["item"]), most)).alias("ord", "e"))
    return e.select(by, "ord", _first_text("e.title").alias("title"), _first_text("e.link").alias("link"), _first_text("e.`content:encoded`", "e.description").alias("content"), _first_text("e.pubDate", "e.`dc:date`").alias("timestamp"), F.lit("").alias("thumbnail"), _first_text("e.author", "e.`dc:creator`").alias("author"))


def json_items(responses: DataFrame, by: list[str], path: Column, body: str = "body", most: int | None = 250) -> DataFrame:
    """(by, ord, raw): the objects of the array at each row's path, the first ``most`` (None: all)."""
    return responses.select(*by, F.posexplode(_first(items_at(F.col(body), path), most)).alias("ord", "raw"))


def map_items(items: DataFrame, paths: dict[str, str], raw: str = "raw") -> DataFrame:
    """Item fields from constant dot paths; what is missing is "". Strings stay bare, other values are JSON text."""
    out = items
    for name in ("title", "link", "content", "timestamp", "thumbnail", "author"):
        p = paths.get(name, "")
        place = "$" + "".join(f"[{x}]" if x.isdigit() else f"['{x}']" for x in p.split(".")) if p else ""
        out = out.withColumn(name, F.coalesce(F.get_json_object(raw, place), F.lit("")) if place else F.lit(""))
    return out


def paged_rows(pages: DataFrame, config: str, most_pages: int, most_items: int, per_page: int | None, item_path: str, kind: str = "page", has_more: str | None = None, total_pages: str | None = None, next_cursor: str | None = None) -> DataFrame:
    """(config, page_idx, ord, raw) of the pages that a paged read would fetch, in order.

    ``pages`` has (config, page_idx, body). Reading stops before a page whose array is missing or empty, and after a page
    that says there is no more, that is the last of the total, that gives no next cursor, or that is short. The page and
    item bounds are tested before each fetch.
    """
    body, order = F.col("body"), Window.partitionBy(config).orderBy("page_idx")
    p = pages.withColumn("items", items_at(body, F.lit(item_path))).withColumn("n", F.coalesce(F.size("items"), F.lit(0)))
    member = lambda path: F.get_json_object(body, "$." + path)
    after = F.lit(False)
    if has_more:
        after = after | F.coalesce(member(has_more).isin("false", "0", "0.0", "", "null", "[]", "{}"), F.lit(True))
    if total_pages:
        after = after | F.coalesce(member(total_pages).try_cast("int") <= F.col("page_idx") + 1, F.lit(False))
    if kind == "cursor":
        after = after | (F.coalesce(member(next_cursor or "next"), F.lit("")) == "")
    elif per_page:
        after = after | (F.col("n") < per_page)
    p = p.withColumn("before_stop", F.col("n") == 0).withColumn("after_stop", after)
    p = p.withColumn("so_far", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = (F.col("before_stop") | (F.col("page_idx") >= most_pages) | (F.col("so_far") >= most_items)).cast("int")
    earlier = F.coalesce(F.max((F.col("before_stop") | F.col("after_stop")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = p.withColumn("own", own).withColumn("earlier", earlier).where("own = 0 and earlier = 0")
    rows = kept.select(config, "page_idx", "so_far", F.posexplode("items").alias("ord", "raw"))
    return rows.where(F.col("so_far") + F.col("ord") < most_items).drop("so_far")


# ---- JSON within scripts ----

SCRIPT = re.compile(r"(?is)<script([^>]*)>(.*?)</script>")
ASSIGNED = re.compile(r"(?:^|[;\s])(?:window|self|globalThis)\s*(?:\.\s*|\[\s*[\"']?)([A-Za-z_$][\w$]*)(?:[\"']?\s*\])?\s*=\s*|(?:^|[;\s])(?:var|let|const)\s+([A-Za-z_$][\w$]*)\s*=\s*")
ATTR = re.compile(r"(\w[\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def balanced(text: str, at: int) -> str | None:
    """The bracketed value that begins at a place of JavaScript text, past strings and comments; null without its end."""
    depth, k, n = 0, at, len(text)
    while k < n:
        c = text[k]
        if c in "\"'`":
            k += 1
            while k < n and text[k] != c:
                k += 2 if text[k] == "\\" else 1
        elif text.startswith("//", k):
            k = (text.find("\n", k) + 1 or n + 1) - 1
        elif text.startswith("/*", k):
            k = (text.find("*/", k) + 2 or n + 2) - 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text[at : k + 1]
        k += 1
    return None


def repaired(text: str):
    return loads(text) if loads(text) is not None else loads(re.sub(r",\s*([}\]])", r"\1", text.strip().rstrip(";")))


def script_values(html: str | None) -> list[tuple[str, str]]:
    """(label, JSON) of the values in a page's scripts: data scripts, known ids, and assignments of known or dunder names."""
    out = []
    for m in SCRIPT.finditer(html or ""):
        attrs = {a[1].lower(): a[2] or a[3] or "" for a in ATTR.finditer(m[1])}
        name, kind, body = attrs.get("id", ""), attrs.get("type", "").lower(), m[2].strip()
        label = f"script#{name}" if name else f"script[type={kind}]"
        if kind in ("application/json", "application/ld+json") or name in L.SCRIPT_NAMES:
            if (v := repaired(body)) is not None:
                out.append((label, json.dumps(v)))
            continue
        seen = set()
        for a in ASSIGNED.finditer(body):
            known = a[2] or (a[1] and (a[1] in L.SCRIPT_NAMES or a[1].startswith("__")))
            at = a.end()
            if known and at < len(body) and body[at] in "{[" and at not in seen:
                seen.add(at)
                got = balanced(body, at)
                if got and (v := repaired(got)) is not None:
                    out.append((f"window.{a[1]}" if a[1] else f"var {a[2]}", json.dumps(v)))
    return out


@arrow_udf("array<struct<label:string,value:string>>")
def embedded_json(html: pd.Series) -> pd.Series:
    return pd.Series([[{"label": a, "value": b} for a, b in script_values(h)] for h in html])


def embedded_candidates(pages: DataFrame, by: str, html: str = "html", least: float = L.MIN_SCORE) -> DataFrame:
    """(by, label, path, n_items, score): the best array of each script value, the best scripts first by rank."""
    v = pages.where(F.lower(html).contains("<script")).select(by, F.posexplode(embedded_json(F.col(html))).alias("ord", "s"))
    v = v.select(by, "ord", "s.label", best_place(F.col("s.value")).alias("b"), "s.value").where(F.col("b.score") >= least)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("b.score"), "ord"))
    return v.select(by, "label", "b.path", "b.n_items", "b.score", "value", rank.alias("rank"))


WHOLE_VALUE = re.compile(r"=\s*([{\[].*[}\]])\s*;?\s*\Z", re.S)


@arrow_udf("string")
def first_script_json(html: pd.Series) -> pd.Series:
    """The first script body that is JSON, or whose assigned value, taken to the script's end, is."""

    def first(page: str | None) -> str | None:
        for m in re.finditer(r"<script[^>]*>(.*?)</script>", page or "", re.S | re.I):
            body = m[1].strip()
            if body[:1] not in ("{", "["):
                assigned = WHOLE_VALUE.search(body)
                body = assigned[1] if assigned else ""
            try:
                if body:
                    json.loads(body)
                    return body
            except ValueError:
                continue
        return None

    return html.map(first)


def first_embedded(pages: DataFrame, by: str, html: str = "html") -> DataFrame:
    """(by, value): the first script that parses, as a scrape takes it, whatever its name: JSON by itself, or all that stands
    behind an equals sign. Where none does, the first value that embedded_json() finds. What a page offers best is embedded_candidates()."""
    value = F.coalesce(first_script_json(F.col(html)), F.get(embedded_json(F.col(html)), F.lit(0))["value"])
    v = pages.where(F.lower(html).contains("<script")).select(by, value.alias("value"))
    return v.where("value is not null")


# ---- captures, HAR, GraphQL ----

HAR = (
    "log struct<entries: array<struct<request: struct<method: string, url: string, headers: array<struct<name: string, value: string>>, postData: struct<text: string>>,"
    " response: struct<status: int, content: struct<mimeType: string, text: string>>>>>"
)


def har_captures(hars: DataFrame, by: str, text: str = "har") -> DataFrame:
    """The JSON exchanges of HAR documents: (by, ord, method, url, status, content_type, body, request_body, headers)."""
    return _captured(hars.select(by, F.posexplode(F.from_json(text, HAR)["log"]["entries"]).alias("ord", "e")), by)


def entry_captures(entries: DataFrame, by: str = "file", ord_: str = "entry", raw: str = "raw") -> DataFrame:
    """What har_captures() gives, from single entries (by, ord_, raw) as readers.HarFiles has them."""
    entry = HAR.partition("entries: array<")[2].removesuffix(">>")
    return _captured(entries.where(F.col(raw).isNotNull()).select(by, F.col(ord_).alias("ord"), F.from_json(raw, entry).alias("e")), by)


def _captured(e: DataFrame, by: str) -> DataFrame:
    body, mime = F.col("e.response.content.text"), content_type(F.col("e.response.content.mimeType"))
    named = F.filter("e.request.headers", lambda h: F.trim(h["name"]) != "")
    last = F.filter(named, lambda h: F.lit(True))
    kept = F.aggregate(last, F.create_map().cast("map<string,string>"), lambda m, h: F.map_concat(F.map_filter(m, lambda k, v: k != h["name"]), F.create_map(h["name"], h["value"])))
    rows = e.select(by, "ord", F.upper(F.coalesce(F.col("e.request.method"), F.lit("GET"))).alias("method"), F.col("e.request.url").alias("url"), F.col("e.response.status").alias("status"), mime.alias("content_type"), body.alias("body"), F.col("e.request.postData.text").alias("request_body"), kept.alias("headers"))
    looks = F.col("content_type").contains("json") | F.ltrim("body").rlike(r"^[\[{]")
    return rows.where((F.length("url") > 0) & looks & F.try_parse_json("body").isNotNull())


def wanted_captures(captures: DataFrame) -> DataFrame:
    """Captures that are neither of binary resources nor of trackers, logins and the like."""
    u = F.lower("url")
    return captures.where(~u.rlike(L.CAPTURE_EXCLUDED) & ~u.rlike(L.BINARY_RESOURCE))


def replay_headers(headers: Column, url: Column) -> Column:
    """The headers that a replay keeps, with Origin and Referer of the page's origin where they are missing."""
    origin = F.concat(F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1))
    kept = F.map_filter(headers, lambda k, v: F.lower(k).isin(L.REPLAY_HEADERS))
    return F.map_concat(kept, F.create_map(F.lit("Origin"), origin, F.lit("Referer"), F.concat(origin, F.lit("/"))))


def endpoints(captures: DataFrame, by: list[str], least: float = L.MIN_SCORE) -> DataFrame:
    """One row per endpoint (by, bucket): the best capture's url, score and number of items, and how many captures there are."""
    c = captures.withColumn("bucket", bucket_key(F.col("method"), F.col("url"))).withColumn("score", feed_score(F.col("body")))
    best = F.max_by(F.struct("url", "score"), F.struct("score", -F.col("ord"))).alias("b")
    return c.groupBy(*by, "bucket").agg(best, F.count("*").alias("n_captures")).where(F.col("b.score") >= least).select(*by, "bucket", "b.url", "b.score", "n_captures")


def body_diff(captures: DataFrame, by: list[str], body: str) -> DataFrame:
    """(by, key, n_values, varying): top-level members of request bodies that change between captures; a missing one is a value."""
    rows = captures.withColumn("m", F.from_json(body, "map<string,string>"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    keys = rows.select(*by, F.explode("m").alias("key", "value")).groupBy(*by, "key").agg(F.count_distinct(F.coalesce("value", F.lit("null"))).alias("k"), F.count("*").alias("there"))
    out = keys.join(n, by).withColumn("n_values", F.col("k") + (F.col("there") < F.col("n")).cast("long"))
    return out.select(*by, "key", "n_values", (F.col("n_values") > 1).alias("varying"))


def graphql_operations(captures: DataFrame, by: str, most: int = 5, least: float = L.MIN_SCORE) -> DataFrame:
    """(by, url, op_name, op_type, path, n_items, score): GraphQL requests, the first of each url and name, scored by response."""
    c = captures.where(is_graphql(F.col("url"), F.col("content_type"), F.col("request_body")))
    query = F.get_json_object("request_body", "$.query")
    name = F.coalesce(F.nullif(F.get_json_object("request_body", "$.operationName"), F.lit("")), operation_name(query))
    c = c.select(by, "ord", "url", name.alias("op_name"), operation_type(F.coalesce(query, F.lit(""))).alias("op_type"), "body")
    c = c.withColumn("k", F.row_number().over(Window.partitionBy(by, "url", "op_name").orderBy("ord"))).where("k = 1")
    c = c.withColumn("b", best_place(F.col("body"))).where(F.col("b.score") >= least)
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("b.score"), "ord"))).where(F.col("rank") <= most)
    return c.select(by, "url", "op_name", "op_type", "b.path", "b.n_items", "b.score", "rank")


def unwrapped(body: Column, path: Column) -> Column:
    """A GraphQL reply's array at the path; an object of one member there, which is an array, is unwrapped."""
    inner = dot_get(body, path)
    keys = F.json_object_keys(inner)
    return F.when((F.size(keys) == 1) & F.ltrim(inner).startswith("{"), F.concat_ws(".", F.nullif(path, F.lit("")), keys[0])).otherwise(path)


def probed_apis(urls: DataFrame, by: str, responses: DataFrame, least: float = L.MIN_SCORE) -> DataFrame:
    """(by, url, path, n_items, score): found URLs (by, url) whose GET response is JSON with a feed-like array, in the order of URLs."""
    r = responses.where((F.col("method") == "GET") & (F.col("status") == 200) & content_type(F.col("content_type")).contains("json")).select("url", "body")
    hit = urls.join(r, "url").withColumn("b", best_place(F.col("body"))).where(F.col("b.score") >= least)
    return hit.select(by, "url", "b.path", "b.n_items", "b.score")


def replayed_queries(found: DataFrame, by: str, replies: DataFrame, least: float = L.MIN_SCORE) -> DataFrame:
    """(by, field, path, n_items, score): fields found by introspection whose reply (by, field, body) holds a feed-like array."""
    r = found.join(replies, [by, "field"]).withColumn("b", best_place(F.col("body"))).where(F.col("b.score") >= least)
    return r.select(by, "field", "b.path", "b.n_items", "b.score")


def introspected_queries(schemas: DataFrame, by: str, text: str = "body", most: int = 3) -> DataFrame:
    """(by, field, type, hits): list fields among the first 20 of a GraphQL schema's query type, by how many feed words they name."""
    kind = "struct<kind:string,name:string,ofType:struct<kind:string,name:string,ofType:struct<kind:string,name:string,ofType:struct<kind:string,name:string>>>>"
    f = schemas.select(by, F.posexplode(F.slice(F.from_json(F.get_json_object(text, "$.data.__schema.queryType.fields"), f"array<struct<name:string,type:{kind}>>"), 1, 20)).alias("ord", "f"))
    t = F.col("f.type")
    bare = F.when(t["kind"] == "NON_NULL", t["ofType"]["kind"]).otherwise(t["kind"])
    inner = F.coalesce(t["ofType"]["ofType"]["ofType"]["name"], t["ofType"]["ofType"]["name"], t["ofType"]["name"])
    words = ["post", "article", "event", "item", "news", "feed", "entry", "story"]
    both = F.lower(F.concat_ws(" ", F.col("f.name"), inner))
    hits = sum((both.contains(w).cast("int") for w in words), F.lit(0))
    f = f.where(bare == "LIST").select(by, "ord", F.col("f.name").alias("field"), inner.alias("type"), hits.alias("hits")).where("hits > 0")
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("hits"), "ord"))).where(F.col("rank") <= most).drop("ord")


# ---- scripts and links ----


def api_urls(scripts: DataFrame, by: str, text: str = "js") -> DataFrame:
    """(by, url): distinct API-like URLs, absolute or relative, that stand in quotes in JavaScript."""
    found = F.array_union(F.regexp_extract_all(text, F.lit(L.JS_ABSOLUTE), F.lit(1)), F.regexp_extract_all(text, F.lit(L.JS_RELATIVE), F.lit(1)))
    return scripts.select(by, F.explode(found).alias("url")).where(is_api_like(F.col("url"))).distinct()


def own_scripts(pages: DataFrame, by: str, origin: str, html: str = "html", responses: DataFrame | None = None, most: int = 5, longest: int = 2_000_000) -> DataFrame:
    """(by, pos, src): the first same-origin scripts of each page, by their absolute URL.

    With responses (url, status, body), the first of those that were fetched and are not too long, with their text as js.
    """
    s = pages.select(by, origin, F.posexplode(F.regexp_extract_all(html, F.lit("(?i)<script[^>]+src=[\"']([^\"']+)[\"']"), F.lit(1))).alias("pos", "raw"))
    s = s.withColumn("src", join_url(F.col(origin), F.col("raw")))
    host = lambda c: F.regexp_extract(c, "^[^:/?#]+://([^/?#]*)", 1)
    s = s.where(host(F.col("src")) == host(F.col(origin))).select(by, "pos", "src")
    first = lambda rows: rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("k") <= most).drop("k")
    if responses is None:
        return first(s)
    r = responses.where((F.col("status") == 200) & (F.length("body") < longest))
    usable = first(s.join(large(r.select(F.col("url").alias("src")).distinct()), "src", "left_semi"))  # addresses alone decide; texts are joined to what is left
    return large(usable).join(large(r.select(F.col("url").alias("src"), F.col("body").alias("js"))), "src").select(by, "pos", "src", "js")


def feed_candidates(pages: DataFrame, by: str, url: str, html: str = "html") -> DataFrame:
    """(by, feed_url, source, ord): linked feeds first, then the usual paths at the page's origin; each URL once.

    Links are resolved against the page's URL. The usual paths are a constant array of each row; only linked feeds can repeat
    them, so nothing but these is compared.
    """
    links = F.regexp_extract_all(html, F.lit("(?i)(<link\\b[^>]*>)"), F.lit(1))
    attr = lambda t, n: F.regexp_extract(t, f"(?i)\\b{n}=[\"']([^\"']*)[\"']", 1)
    feeds = F.filter(links, lambda t: F.contains(F.lower(attr(t, "rel")), F.lit("alternate")) & content_type(attr(t, "type")).isin(L.FEED_TYPES))
    origin = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    own = pages.select(by, url, origin.alias("origin"), F.transform(feeds, lambda t: attr(t, "href")).alias("hrefs"))
    linked = own.select(by, url, F.posexplode("hrefs").alias("pos", "href")).select(by, join_url(F.col(url), F.col("href")).alias("feed_url")).where("feed_url <> ''").distinct()
    named = linked.groupBy(by).agg(F.collect_set("feed_url").alias("linked"))
    probes = own.select(by, "origin").join(named, by, "left").select(by, "linked", F.posexplode(F.transform(F.array(*map(F.lit, L.FEED_PATHS)), lambda p: F.concat("origin", p))).alias("ord", "feed_url"))
    probes = probes.where(F.col("linked").isNull() | ~F.array_contains("linked", F.col("feed_url")))
    return linked.select(by, "feed_url", F.lit("link").alias("source"), F.lit(0).alias("ord")).union(probes.select(by, "feed_url", F.lit("path").alias("source"), (F.col("ord") + 1).alias("ord")))


def probe_feeds(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """candidates with is_alive, feed_kind and parse_error from the HEAD response or else the GET response of their URL."""
    alive = (F.col("status").between(200, 299)) & feed_type(content_type(F.col("content_type"))).isNotNull()
    error = F.concat_ws(" ", "method", F.col("status").cast("string"), content_type(F.col("content_type")))
    r = responses.select(F.col("url").alias("feed_url"), "method", alive.alias("ok"), feed_type(content_type(F.col("content_type"))).alias("k"), error.alias("error"))
    best = r.groupBy("feed_url").agg(F.max("ok").alias("is_alive"), F.max_by("k", F.when(F.col("ok"), F.when(F.col("method") == "HEAD", 2).otherwise(1)).otherwise(0)).alias("k"), F.min_by("error", F.when(F.col("method") == "GET", 0).otherwise(1)).alias("error"))
    out = candidates.join(best, "feed_url", "left").withColumn("is_alive", F.coalesce("is_alive", F.lit(False)))
    return out.select(*candidates.columns, "is_alive", F.when(F.col("is_alive"), F.col("k")).alias("feed_kind"), F.when(~F.col("is_alive"), F.coalesce("error", F.lit("no response"))).alias("parse_error"))
