"""Queries over the corpus tables, by name, and for most of them SQL that gives the same rows without rendering or parsing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from ..functions.json_walk import best_place, dot_get, key_roles, list_of_objects, paging, sample_keys, score_of_items
from ..operators import candidates as C
from ..operators import anchors, export, prune, xpath
from ..operators import items as I
from ..sources import documents as D
from ..sources.dom import nodes, shared, tag_tokens
from ..sources.written import large
from . import render as R
from .render import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


TITLE_SQL = "'Order ' || o_orderkey || ' & ' || o_orderpriority"
DATE_SQL = "strftime(o_orderdate, '%Y-%m-%d')"


# ---- pages ----


@query(r"""SELECT page_id, substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 200) AS title,
  CASE WHEN regexp_extract(html, '(?i)<link[^>]+rel=["'']canonical["''][^>]+href=["'']([^"'']+)["'']', 1) = '' THEN url
       ELSE regexp_extract(html, '(?i)<link[^>]+rel=["'']canonical["''][^>]+href=["'']([^"'']+)["'']', 1) END AS canonical,
  length(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_len, len(regexp_extract_all(lower(html), '<script')) AS n_scripts,
  len(regexp_extract_all(lower(html), '<script')) > 5 AND length(regexp_replace(html, '<[^>]+>', '', 'g')) < 2000 AS has_js FROM pages""")
def page_meta(spark: SparkSession, d: str) -> DataFrame:
    canonical = F.regexp_extract("html", "(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']+)[\"']", 1)
    length, scripts = F.length(F.regexp_replace("html", "<[^>]+>", "")), F.regexp_count(F.lower("html"), F.lit("<script"))
    return table(spark, d, "pages").select("page_id", F.substring(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), 1, 200).alias("title"), F.when(canonical == "", F.col("url")).otherwise(canonical).alias("canonical"), length.cast("long").alias("text_len"), scripts.cast("long").alias("n_scripts"), ((scripts > 5) & (length < 2000)).alias("has_js"))


MARKS = [*L.FRAMEWORKS.values(), *L.ANTI_BOT]


@query("SELECT o_orderkey AS page_id, CASE " + " ".join(f"WHEN o_orderkey % 15 = {k} THEN '{n}'" for k, n in enumerate(L.FRAMEWORKS)) + f" ELSE '' END AS frameworks, o_orderkey % 15 BETWEEN {len(L.FRAMEWORKS)} AND {len(MARKS) - 1} AS anti_bot FROM orders")
def framework_flags(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("<html><DIV "), F.coalesce(F.try_element_at(F.array(*map(F.lit, MARKS)), (F.col("o_orderkey") % 15 + 1).cast("int")), F.lit("x")), F.lit(">")).alias("html"))
    low = F.lower("html")
    found = F.array_compact(F.array(*[F.when(low.contains(m), n) for n, m in L.FRAMEWORKS.items()]))
    bot = F.lit(False)
    for m in L.ANTI_BOT:
        bot = bot | low.contains(m)
    return o.select("page_id", F.array_join(found, ",").alias("frameworks"), bot.alias("anti_bot"))


TOKENS_SQL = "SELECT page_id, pos, tok[pos] AS token FROM (SELECT page_id, regexp_extract_all(html, '(</?[a-zA-Z][^>]*>)', 1) AS tok FROM pages), unnest(range(1, len(tok) + 1)) AS u(pos)"


@query(f"SELECT lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM ({TOKENS_SQL}) WHERE token NOT LIKE '</%' GROUP BY 1")
def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tag_tokens(table(spark, d, "pages")).where("not closing").groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


VOID_SQL = "'br','meta','link','img','input','hr'"


@query(f"""SELECT page_id, max(depth)::BIGINT AS max_depth FROM (SELECT page_id, sum(CASE WHEN token LIKE '</%' THEN -1
  WHEN lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) IN ({VOID_SQL}) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM ({TOKENS_SQL})) GROUP BY 1""")
def tag_depth(spark: SparkSession, d: str) -> DataFrame:
    t = tag_tokens(table(spark, d, "pages"))
    step = F.when(F.col("closing"), -1).when(F.col("tag").isin("br", "meta", "link", "img", "input", "hr"), 0).otherwise(1)
    return t.withColumn("depth", F.sum(step).over(Window.partitionBy("page_id").orderBy("pos"))).groupBy("page_id").agg(F.max("depth").alias("max_depth"))


@query("SELECT page_id, count(*) AS n_nodes, sum(CASE WHEN tag = 'li' THEN 1 ELSE 0 END)::BIGINT AS n_li FROM (SELECT page_id, lower(regexp_extract(token, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM (SELECT page_id, unnest(regexp_extract_all(replace(html, 'var t=\"</p>\"', ''), '(<[a-zA-Z][^>]*>)', 1)) AS token FROM pages)) GROUP BY 1")
def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return nodes(table(spark, d, "pages"), "tag").groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("tag") == "li").alias("n_li"))


@query("SELECT page_id, pos, href, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || href AS target FROM (SELECT page_id, url, unnest(range(0, len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages))")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    a = nodes(table(spark, d, "pages"), "pre", "tag", "attrs", carry="url").where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    a = a.select("page_id", "url", (F.row_number().over(Window.partitionBy("page_id").orderBy("pre")) - 1).cast("long").alias("pos"), F.col("attrs")["href"].alias("href"))
    return a.select("page_id", "pos", "href", S.join_url(F.col("url"), F.col("href")).alias("target"))


@query(r"SELECT page_id, regexp_extract(url, '^([^:/?#]+)://', 1) AS scheme, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, 'GET ' || regexp_extract(url, '^([^?#]*)', 1) AS bucket FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p: F.try_parse_url("url", F.lit(p))
    return table(spark, d, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), F.coalesce(part("PATH"), F.lit("")).alias("path"), S.bucket_key(F.lit("get"), F.col("url")).alias("bucket"))


@query(r"SELECT page_id, CASE WHEN url LIKE '%?page=%' THEN regexp_replace(url, 'page=\d+', 'page=7') WHEN url LIKE '%?%' THEN regexp_replace(url, '(\?[^#]*)', '\1&page=7') ELSE regexp_replace(url, '^([^#]*)', '\1?page=7') END AS next_url FROM pages")
def set_query_param(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.set_query_param(F.col("url"), F.lit("page"), F.lit("7")).alias("next_url"))


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\u00a0", "&amp;": "&"}
H1_SQL = "regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g')"
for _entity, _char in ENTITIES.items():
    H1_SQL = f"replace({H1_SQL}, '{_entity}', '{_char}')"


@query(f"SELECT page_id, trim(regexp_replace({H1_SQL}, '\\s+', ' ', 'g')) AS prose FROM pages")
def prune_keep(spark: SparkSession, d: str) -> DataFrame:
    n = prune.kept_nodes(nodes(table(spark, d, "pages"), *prune.PRUNE_COLUMNS, "text"))
    return n.where("tag = 'h1'").select("page_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("prose"))


@query()
def skeleton_text(spark: SparkSession, d: str) -> DataFrame:
    return prune.skeletons(nodes(table(spark, d, "pages"), *prune.PRUNE_COLUMNS))


@query("""SELECT o_custkey AS page_id, 'article' AS tag, CASE WHEN o_orderkey % 5 = 0 THEN 'featured' ELSE 'post-card' END AS cls, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 3
  UNION ALL SELECT o_custkey, unnest(['h2', 'p']), unnest(['post-card__title', 'summary']), count(*) FROM orders GROUP BY 1 HAVING count(*) >= 3 UNION ALL SELECT DISTINCT o_custkey, 'li', 'menu-item', 3 FROM orders""")
def class_inventory_rendered(spark: SparkSession, d: str) -> DataFrame:
    return prune.class_inventory(nodes(R.html_lists(spark, d), "pre", "tag", "cls", classed=True)).select("page_id", "tag", "cls", "n")


@query("SELECT o_orderkey AS script_id, unnest(['/api/orders/' || o_orderkey, 'https://h.example.com/v1/items?id=' || o_orderkey]) AS url FROM orders")
def api_url_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    js = F.concat(F.lit('fetch("/api/orders/'), k, F.lit("\");load('https://cdn.example.com/app.js');x=`https://h.example.com/v1/items?id="), k, F.lit('`;y="https://t.example.com/pixel/v1/x";z="/api/orders/'), k, F.lit('"'))
    return D.api_urls(table(spark, d, "orders").select(F.col("o_orderkey").alias("script_id"), js.alias("js")), "script_id")


# ---- JSON ----

PAYLOAD_SCORE = "round(CASE WHEN count(*) BETWEEN 5 AND 100 THEN 0.15 ELSE 0.05 END + 0.25 + 0.20 + 0.15 + CASE WHEN count(*) >= 3 THEN 0.07 ELSE 0 END, 3)::DOUBLE"


@query(f"SELECT o_custkey AS cust, {PAYLOAD_SCORE} AS score FROM orders GROUP BY 1")
def json_score(spark: SparkSession, d: str) -> DataFrame:
    p = R.json_payloads(spark, d).withColumn("items", list_of_objects(F.get_json_object("body", "$.data")))
    return p.select("cust", score_of_items(F.col("items")).cast("double").alias("score"))


@query(f"SELECT o_custkey AS cust, 'data.posts' AS path, count(*)::INT AS n_items, {PAYLOAD_SCORE} AS score FROM orders GROUP BY 1")
def json_best_path(spark: SparkSession, d: str) -> DataFrame:
    return R.json_payloads(spark, d).select("cust", best_place(F.col("body")).alias("b")).select("cust", "b.path", "b.n_items", "b.score")


@query(f"SELECT o_custkey AS cust, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, {TITLE_SQL} AS title, '/orders/' || o_orderkey AS link, '' AS content, {DATE_SQL} AS timestamp, '' AS thumbnail, '' AS author FROM orders")
def json_items(spark: SparkSession, d: str) -> DataFrame:
    p = R.json_payloads(spark, d).withColumn("path", best_place(F.col("body"))["path"])
    rows = D.json_items(p, ["cust"], F.col("path"), most=5_000)
    return D.map_items(rows, {"title": "title", "link": "url", "timestamp": "published_at"}).select("cust", "ord", *I.FIELDS)


@query("""SELECT cust, page_idx, (k - page_idx * 4)::INT AS ord, '/orders/' || o_orderkey AS link FROM (SELECT o_custkey AS cust, o_orderkey, k, (k // 4)::INT AS page_idx FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)) WHERE page_idx < 3 AND k < 10""")
def json_paged_items(spark: SparkSession, d: str) -> DataFrame:
    rows = D.paged_rows(R.json_payloads(spark, d, page_size=4), "cust", most_pages=3, most_items=10, per_page=4, item_path="data.posts")
    return rows.select("cust", "page_idx", "ord", F.get_json_object("raw", "$.url").alias("link"))


@query("SELECT o_custkey AS cust, least(ceil(count(*) / 4.0), 3)::BIGINT AS pages_read FROM orders GROUP BY 1")
def page_stop(spark: SparkSession, d: str) -> DataFrame:
    rows = D.paged_rows(R.json_payloads(spark, d, page_size=4), "cust", most_pages=3, most_items=5_000, per_page=4, item_path="data.posts")
    return rows.groupBy("cust").agg(F.count_distinct("page_idx").alias("pages_read"))


@query("SELECT DISTINCT o_custkey AS cust, 'published_at,tag,title,url' AS keys FROM orders")
def sample_key_lists(spark: SparkSession, d: str) -> DataFrame:
    p = R.json_payloads(spark, d)
    return p.select("cust", F.array_join(sample_keys(F.from_json(F.get_json_object("body", "$.data.posts"), "array<map<string,string>>")), ",").alias("keys"))


@query("SELECT DISTINCT o_custkey AS cust, unnest(['title', 'url', 'date']) AS role, unnest(['title', 'url', 'published_at']) AS key FROM orders")
def key_role_map(spark: SparkSession, d: str) -> DataFrame:
    keys = R.json_payloads(spark, d).select("cust", F.explode(F.map_keys(F.from_json(F.get_json_object("body", "$.data.posts[0]"), "map<string,string>"))).alias("key"))
    return key_roles(keys, "cust")


@query("SELECT o_custkey AS cust, '/orders/' || min(o_orderkey) AS first_url, '/orders/' || max(o_orderkey) AS last_url FROM orders GROUP BY 1")
def dot_paths(spark: SparkSession, d: str) -> DataFrame:
    p = R.json_payloads(spark, d)
    return p.select("cust", dot_get(F.col("body"), F.lit("data.posts.0.url")).alias("first_url"), dot_get(F.col("body"), F.lit("data.posts[-1].url")).alias("last_url"))


@query(f"SELECT o_custkey AS cust, CASE WHEN o_custkey % 2 = 0 THEN 'script#__NEXT_DATA__' ELSE 'window.__DATA__' END AS label, 'data.posts' AS path, count(*)::INT AS n_items, {PAYLOAD_SCORE} AS score FROM orders GROUP BY 1")
def embedded_json_candidates(spark: SparkSession, d: str) -> DataFrame:
    return D.embedded_candidates(R.embedded_pages(spark, d), "cust").where("rank = 1").select("cust", "label", "path", "n_items", "score")


@query(f"SELECT o_custkey AS cust, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, {TITLE_SQL} AS title FROM orders QUALIFY ord < 100")
def embedded_items(spark: SparkSession, d: str) -> DataFrame:
    best = D.embedded_candidates(R.embedded_pages(spark, d), "cust").where("rank = 1")
    return D.json_items(best, ["cust"], F.col("path"), "value", most=100).select("cust", "ord", F.get_json_object("raw", "$.title").alias("title"))


@query("SELECT o_custkey AS cust, 'https://shop.example.com/graphql' AS url, 'Posts' AS op_name, 'query' AS op_type, 'data.posts' AS path, count(*)::INT AS n_items FROM orders GROUP BY 1")
def graphql_detect(spark: SparkSession, d: str) -> DataFrame:
    return D.graphql_operations(D.wanted_captures(R.captures(spark, d)), "cust").select("cust", "url", "op_name", "op_type", "path", "n_items")


@query("SELECT o_custkey AS cust, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, '/orders/' || o_orderkey AS link FROM orders QUALIFY ord < 100")
def graphql_items(spark: SparkSession, d: str) -> DataFrame:
    c = R.captures(spark, d).where((F.col("ord") == 0) & S.is_graphql(F.col("url"), F.col("content_type"), F.col("request_body"))).drop("ord")
    return D.json_items(c, ["cust"], F.lit("data.posts"), most=100).select("cust", "ord", F.get_json_object("raw", "$.url").alias("link"))


@query("SELECT o_custkey AS cust, count(DISTINCT o_orderstatus) AS n_captures, count(DISTINCT o_orderstatus) AS n_with_accept FROM orders GROUP BY 1")
def har_captures(spark: SparkSession, d: str) -> DataFrame:
    c = D.har_captures(R.hars(spark, d), "cust").withColumn("replay", D.replay_headers(F.col("headers"), F.col("url")))
    return c.groupBy("cust").agg(F.count("*").alias("n_captures"), F.count_if(F.map_contains_key("replay", "Accept") & ~F.map_contains_key("replay", "Cookie")).alias("n_with_accept"))


@query("""SELECT cust, 'GET https://api.example.com/search' AS bucket, max(score) AS score, count(*) AS n_captures FROM (SELECT o_custkey AS cust, o_orderstatus,
  round(CASE WHEN count(*) BETWEEN 5 AND 100 THEN 0.15 ELSE 0.05 END + 0.25 + 0.20 + 0.15 + CASE WHEN count(*) >= 3 THEN 0.07 ELSE 0 END, 3)::DOUBLE AS score FROM orders GROUP BY ALL) GROUP BY 1""")
def har_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return D.endpoints(D.har_captures(R.hars(spark, d), "cust"), ["cust"]).select("cust", "bucket", F.col("score").cast("double"), "n_captures")


@query("SELECT DISTINCT o_custkey AS cust, unnest(['page', 'size']) AS key, unnest([2, 1])::BIGINT AS n_values, unnest([true, false]) AS varying FROM orders")
def body_diff(spark: SparkSession, d: str) -> DataFrame:
    c = R.captures(spark, d).where("request_body is not null").withColumn("variables", F.get_json_object("request_body", "$.variables"))
    return D.body_diff(c, ["cust"], "variables")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 0 THEN 'body' ELSE 'query' END AS location, CASE o_orderkey % 4 WHEN 0 THEN 'pageNumber' WHEN 1 THEN 'offset' WHEN 2 THEN 'after' END AS param,
  CASE o_orderkey % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'offset' WHEN 2 THEN 'cursor' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 20 WHEN 2 THEN 0 END AS start, CASE o_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 END AS per_page,
  CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'info.hasMore' END AS has_more_path, CASE o_orderkey % 4 WHEN 2 THEN 'info.endCursor' END AS next_cursor_path FROM orders""")
def pagination_detect(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, '{"q":"x","pageNumber":3,"perPage":10}').alias("body"), F.when(k == 1, "https://h/x?offset=20&limit=20").when(k == 2, "https://h/x?after=abc").otherwise("https://h/x?q=1").alias("url"), F.lit('{"info":{"hasMore":true,"endCursor":"e"},"pages":{"x":1}}').alias("reply"))
    return o.select("id", paging(F.col("body"), F.col("url"), F.col("reply")).alias("p")).select("id", "p.location", "p.param", "p.kind", "p.start", "p.per_page", "p.has_more_path", "p.next_cursor_path")


FEED_SQL = f"SELECT o_custkey AS cust, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, {TITLE_SQL} AS title, '/orders/' || o_orderkey AS link, o_orderstatus AS content, {DATE_SQL} || '@' AS timestamp, '' AS thumbnail, '' AS author FROM orders QUALIFY ord < 100"


@query(FEED_SQL.replace("'@'", "'T00:00:00Z'"))
def atom_items(spark: SparkSession, d: str) -> DataFrame:
    return D.atom_items(R.feeds_xml(spark, d, "atom"), "cust")


@query(FEED_SQL.replace("'@'", "''"))
def rss_items(spark: SparkSession, d: str) -> DataFrame:
    return D.rss_items(R.feeds_xml(spark, d, "rss"), "cust")


@query("""SELECT page_id, count(*) AS n_candidates, sum(CASE WHEN source = 'link' THEN 1 ELSE 0 END)::BIGINT AS n_linked, sum(CASE WHEN alive THEN 1 ELSE 0 END)::BIGINT AS n_alive FROM
  (SELECT c_custkey AS page_id, unnest(range(0, 15)) AS k, CASE WHEN k = 0 THEN 'link' ELSE 'path' END AS source, k = 0 AND c_custkey % 3 = 0 OR k = 1 AND c_custkey % 3 = 1 AS alive FROM customer) GROUP BY 1""")
def probe_liveness(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey").cast("string")
    pages = c.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://c"), k, F.lit(".example.com/home")).alias("url"), F.lit('<head><link rel="alternate" type="application/atom+xml" href="/my.atom"><link rel="stylesheet" type="text/css" href="/x.css"></head>').alias("html"))
    origin = F.concat(F.lit("https://c"), k, F.lit(".example.com"))
    head = c.where("c_custkey % 3 = 0").select(F.concat(origin, F.lit("/my.atom")).alias("url"), F.lit("HEAD").alias("method"), F.lit(200).alias("status"), F.lit("application/atom+xml; charset=utf-8").alias("content_type"))
    get = c.where("c_custkey % 3 = 1").select(F.concat(origin, F.lit("/feed")).alias("url"), F.lit("GET").alias("method"), F.lit(200).alias("status"), F.lit("text/xml").alias("content_type"))
    dead = c.where("c_custkey % 3 = 1").select(F.concat(origin, F.lit("/rss")).alias("url"), F.lit("HEAD").alias("method"), F.lit(404).alias("status"), F.lit("text/html").alias("content_type"))
    found = D.probe_feeds(D.feed_candidates(pages, "page_id", "url"), head.union(get).union(dead))
    return found.groupBy("page_id").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("source") == "link").alias("n_linked"), F.count_if("is_alive").alias("n_alive"))


# ---- HTML lists ----

BLOCKS = "//article[contains(@class,'post-card')]"
FIELDS = {"title": ".//h2/a", "link": ".//h2/a/@href", "content": ".//p[@class='summary']", "timestamp": ".//time/@datetime"}
PRICE_SQL = "'Priced at ' || o_totalprice || ' in all, thank youfor the order'"


@query(f"SELECT o_custkey AS page_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, {TITLE_SQL} AS title, '/orders/' || o_orderkey AS link, {DATE_SQL} AS timestamp FROM orders WHERE o_orderkey % 5 <> 0 QUALIFY ord < 100")
def xpath_items(spark: SparkSession, d: str) -> DataFrame:
    return xpath.scan(R.html_lists(spark, d), BLOCKS, {k: v for k, v in FIELDS.items() if k != "content"})


@query(f"SELECT o_custkey AS page_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, {TITLE_SQL} AS title, '/orders/' || o_orderkey AS link FROM orders QUALIFY ord < 100")
def xpath_union_items(spark: SparkSession, d: str) -> DataFrame:
    return xpath.scan(R.html_lists(spark, d), f"({BLOCKS}) | (//article[@class='featured'])", {k: FIELDS[k] for k in ("title", "link")})


@query(f"SELECT o_custkey AS page_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, {TITLE_SQL} AS title, '/orders/' || o_orderkey AS link, {DATE_SQL} AS timestamp FROM orders WHERE o_orderkey % 5 <> 0 QUALIFY ord < 100")
def xpath_recipe_items(spark: SparkSession, d: str) -> DataFrame:
    """The same items, by a recipe that stands in the row."""
    p = R.html_lists(spark, d).withColumn("x", xpath.extract_items(F.col("html"), F.lit(BLOCKS), F.lit(json.dumps(FIELDS)), F.lit("")))
    return p.select("page_id", F.explode("x.items").alias("i")).select("page_id", "i.ord", "i.title", "i.link", "i.timestamp")


N_CARDS = "sum(CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END)"
#: Blocks of one class, three or more of them, with their confidence in hundredths; menu entries count as unlikely, and two
#: classes of about equal confidence make a union, the more frequent one first.
BLOCKS_SQL = "SELECT o_custkey AS page_id, CASE WHEN o_orderkey % 5 = 0 THEN 'featured' ELSE 'post-card' END AS cls, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2 HAVING count(*) >= 3"
HUNDREDTHS_SQL = "(greatest(50, least(950, least(300 + (n - 3) * 30, 850) + 5 * CASE WHEN cls = 'post-card' THEN 35 ELSE 10 END)) + 5) // 10"


@query(f"""WITH b AS (SELECT page_id, '//article[contains(@class,''' || cls || ''')]' AS selector, n, first, {HUNDREDTHS_SQL} AS c FROM ({BLOCKS_SQL}))
SELECT page_id, selector, n AS item_count, (c / 100)::DOUBLE AS confidence, false AS is_union FROM b
UNION ALL SELECT DISTINCT o_custkey, '//li[contains(@class,''menu-item'')]', 3, 0.05::DOUBLE, false FROM orders
UNION ALL SELECT x.page_id, x.selector || ' | ' || y.selector, x.n + y.n, ((greatest(x.c, y.c) - 5) / 100)::DOUBLE, true FROM b x JOIN b y ON x.page_id = y.page_id AND (x.n > y.n OR (x.n = y.n AND x.first < y.first))
  WHERE x.c >= 35 AND y.c >= 35 AND abs(x.c - y.c) <= 15 AND x.n + y.n BETWEEN 5 AND 50""")
def xpath_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = C.repeated_blocks(nodes(R.html_lists(spark, d), *C.BLOCK_COLUMNS, tags=L.ITEM_TAGS))
    return c.select("page_id", "selector", "item_count", F.col("confidence").cast("double"), "is_union")


@query()
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = shared(nodes(R.html_lists(spark, d), *C.PARSER_COLUMNS, tags=[*L.ITEM_TAGS, *L.LOW_VALUE_ANCESTORS]))
    return C.merge(C.repeated_blocks(n), C.parser_candidates(n))


@query("""SELECT page_id, CASE WHEN w THEN '//article[contains(@class,''post-card'')]' ELSE '//article[contains(@class,''featured'')]' END AS selector, CASE WHEN w THEN cards ELSE featured END AS item_count FROM
  (SELECT *, featured < 3 OR (cards >= 3 AND (cards > featured OR (cards = featured AND first_card < first_featured))) AS w FROM (SELECT o_custkey AS page_id, count(*) FILTER (o_orderkey % 5 <> 0) AS cards, count(*) FILTER (o_orderkey % 5 = 0) AS featured,
   min(o_orderkey) FILTER (o_orderkey % 5 <> 0) AS first_card, min(o_orderkey) FILTER (o_orderkey % 5 = 0) AS first_featured FROM orders GROUP BY 1)) WHERE greatest(cards, featured) >= 3""")
def date_anchor_items(spark: SparkSession, d: str) -> DataFrame:
    """Of two classes with equally many dated items, that which comes first in the page is shown."""
    return anchors.date_anchors(R.html_lists(spark, d)).select("page_id", "selector", "item_count")


@query("SELECT o_custkey AS page_id, CASE WHEN arg_min(o_orderkey, o_orderkey) % 5 = 0 THEN '//article[contains(@class,''featured'')]' ELSE '//article[contains(@class,''post-card'')]' END AS selector, CASE WHEN min(o_orderkey) % 5 = 0 THEN count(*) FILTER (o_orderkey % 5 = 0) ELSE count(*) FILTER (o_orderkey % 5 <> 0) END AS item_count, 2::BIGINT AS n_fields FROM orders GROUP BY 1 HAVING item_count >= 2")
def lca_anchor(spark: SparkSession, d: str) -> DataFrame:
    o = R.order_items(spark, d)
    first = o.groupBy(F.col("cust").alias("page_id")).agg(F.min_by(F.struct("title", "price"), "key").alias("i"))
    price = F.concat(F.lit("Priced at "), F.col("i.price").cast("string"), F.lit(" in"))
    examples = first.select("page_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("i.title").alias("needle")), F.struct(F.lit("content").alias("field"), price.alias("needle")))).alias("e")).select("page_id", "e.*")
    return anchors.example_anchors(R.html_lists(spark, d), examples)


@query()
def fuzzy_recover(spark: SparkSession, d: str) -> DataFrame:
    """For each page the block whose heading is most like a mistyped example."""
    n = nodes(R.html_lists(spark, d), "pre", "text", tags=["h2"])
    example = R.order_items(spark, d).groupBy(F.col("cust").alias("page_id")).agg(F.min_by("title", "key").alias("t")).withColumn("example", F.replace("t", F.lit("Order"), F.lit("ORDRE ")))
    hits = n.join(example, "page_id").withColumn("ratio", S.similarity_from(F.col("text"), F.col("example"), F.lit(0.75))).where("ratio is not null")
    return hits.groupBy("page_id").agg(F.max_by("text", F.struct("ratio", -F.col("pre"))).alias("text"), F.round(F.max("ratio"), 6).alias("ratio"))


@query("SELECT o_custkey AS cust, least(count(*), 10) AS n_items, least(count(*), 10) AS n_title, least(count(*), 10) AS n_link, 0::BIGINT AS n_content, least(count(*), 10) AS n_timestamp, 0::BIGINT AS n_thumbnail, 0::BIGINT AS n_author FROM orders GROUP BY 1")
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return I.coverage(json_items(spark, d), ["cust"])


@query("SELECT o_custkey AS cust, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, '/orders/' || o_orderkey AS link FROM orders QUALIFY ord < 10")
def preview_topk(spark: SparkSession, d: str) -> DataFrame:
    return I.first_n(json_items(spark, d), ["cust"], ["ord"], 10).select("cust", "ord", "link")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return I.keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


FEEDS = "SELECT c_custkey AS feed_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS config_id FROM customer"


def _feeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    feeds = table(spark, d, "customer").select(F.col("c_custkey").alias("feed_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("config_id"))
    return feeds, table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("config_id"), F.col("n_name").alias("config"))


@query(f"SELECT feed_id, config_id, n_name AS config, CASE WHEN config_id IS NULL THEN 'no config' WHEN n_name IS NULL THEN 'config not found' END AS error FROM ({FEEDS}) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON config_id = n_nationkey")
def feed_config_join(spark: SparkSession, d: str) -> DataFrame:
    return I.feeds_with_configs(*_feeds(spark, d)).select("feed_id", "config_id", "config", "error")


@query(f"SELECT feed_id FROM ({FEEDS}) WHERE config_id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def feed_missing_config(spark: SparkSession, d: str) -> DataFrame:
    return I.feeds_with_configs(*_feeds(spark, d)).where("error = 'config not found'").select("feed_id")


LOG = "SELECT user_id AS feed_id, ts, event_id, event_type <> 'error' AS ok, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS item_count FROM events"
STATES = f"""SELECT feed_id, event_id, ts, ok, sum(CASE WHEN ok AND item_count = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INT AS streak FROM
  (SELECT *, sum(CASE WHEN ok AND item_count > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM ({LOG}))"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    return I.refresh_states(R.refresh_log(spark, d).withColumn("at", F.struct("ts", "event_id")), order="at")


@query(f"SELECT feed_id, event_id, streak FROM ({STATES})")
def refresh_state(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("feed_id", "event_id", "streak")


@query(f"SELECT feed_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(streak, (ts, event_id)) AS streak FROM ({STATES}) WHERE ok AND streak >= 3 GROUP BY 1")
def drift_triggers(spark: SparkSession, d: str) -> DataFrame:
    return I.drift_triggers(_states(spark, d), order="at").select("feed_id", "event_id", "streak")


CADENCES = ["15m", "1h", "6h", "1d", "1w", "on_demand"]


@query("""SELECT feed_id, cadence FROM (SELECT user_id AS feed_id, max(ts) AS last, ['15m', '1h', '6h', '1d', '1w', 'on_demand'][user_id % 6 + 1] AS cadence FROM events GROUP BY 1)
  WHERE cadence <> 'on_demand' AND epoch((SELECT max(ts) FROM events))::BIGINT - epoch(last)::BIGINT >= CASE cadence WHEN '15m' THEN 900 WHEN '1h' THEN 3600 WHEN '6h' THEN 21600 WHEN '1d' THEN 86400 ELSE 604800 END""")
def due_feeds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    f = e.groupBy(F.col("user_id").alias("feed_id")).agg(F.date_trunc("second", F.max("ts")).alias("last_refresh_at")).withColumn("cadence", F.element_at(F.array(*map(F.lit, CADENCES)), (F.col("feed_id") % 6 + 1).cast("int")))
    return I.due_feeds(f.join(F.broadcast(now)), F.col("now")).select("feed_id", "cadence")


@query("SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 86400")
def ttl_sweep(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return I.unexpired(e.join(F.broadcast(now)), "ts", F.col("now"), 86_400).select("event_id")


@query("""SELECT user_id, session, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS session FROM
  (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 7200 THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY ALL""")
def sliding_ttl_sessions(spark: SparkSession, d: str) -> DataFrame:
    return I.sliding_sessions(table(spark, d, "events"), "user_id", "ts", 7_200)


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > 30 AS over_limit FROM events GROUP BY ALL")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("minute"), "n", (F.col("n") > 30).alias("over_limit"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 60")
def trace_last60(spark: SparkSession, d: str) -> DataFrame:
    return I.first_n(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 60).select("user_id", "event_id")


# ---- exports, gates, replies ----


@query(f"""SELECT o_custkey AS cust, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, '/orders/' || o_orderkey AS entry_id,
  '<entry><id>/orders/' || o_orderkey || '</id><title>' || replace({TITLE_SQL}, '&', '&amp;') || '</title><updated>' || {DATE_SQL} || 'T00:00:00Z</updated><link href="/orders/' || o_orderkey || '"/><published>' || {DATE_SQL} || 'T00:00:00Z</published></entry>' AS entry FROM orders""")
def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    return export.atom_entries(json_items(spark, d), "cust")


@query("SELECT 'item:' || substr(sha256(p_name), 1, 16) AS entry_id, p_partkey AS part FROM part")
def entry_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.lit("").alias("link"), F.col("p_name").alias("title"), F.col("p_partkey").alias("part")).select(export.entry_id().alias("entry_id"), "part")


def _opml_feeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    paths = F.create_map(*map(F.lit, ["item", "//li", "title", ".//b", "link", ".//a/@href"]))
    return table(spark, d, "supplier").select(k.alias("feed_id"), F.concat("s_name", F.lit(" & co")).alias("name"), F.when(k % 5 != 0, F.concat(F.lit("https://f.example.com/"), k.cast("string"), F.lit("?a=1&b=2"))).otherwise("").alias("feed_url"), F.concat(F.lit("https://s.example.com/"), k.cast("string")).alias("source_url"), F.when(k % 2 == 0, "xpath").otherwise("rss").alias("strategy"), paths.alias("selectors"), "s_nationkey")


OUTLINE_SQL = """'<outline text="' || s_name || ' &amp; co" title="' || s_name || ' &amp; co"' ||"""
NATIVE_SQL = OUTLINE_SQL + """ CASE WHEN s_suppkey % 2 = 0 THEN ' type="HTML+XPath" xmlUrl="https://s.example.com/' || s_suppkey || '" htmlUrl="https://s.example.com/' || s_suppkey || '" frss:xPathItem="//li" frss:xPathItemTitle=".//b" frss:xPathItemUri=".//a/@href" frss:xPathItemUid=".//a/@href"/>' ELSE ' type="rss" xmlUrl="https://f.example.com/' || s_suppkey || '?a=1&amp;b=2" htmlUrl="https://s.example.com/' || s_suppkey || '"/>' END"""
PLAIN_SQL = OUTLINE_SQL + """ ' type="rss" xmlUrl="https://f.example.com/' || s_suppkey || '?a=1&amp;b=2" htmlUrl="https://s.example.com/' || s_suppkey || '"/>'"""


@query(f"SELECT s_suppkey AS feed_id, {NATIVE_SQL} AS outline FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 2 = 0")
def opml_rows(spark: SparkSession, d: str) -> DataFrame:
    return export.opml_outlines(_opml_feeds(spark, d), native=True)


@query(f"""SELECT s_nationkey, '<?xml version="1.0" encoding="UTF-8"?><opml version="2.0"><head><title>Saved feeds</title><dateCreated>Wed, 01 May 2024 10:00:00 +0000</dateCreated></head><body>' || string_agg({PLAIN_SQL}, '' ORDER BY s_suppkey) || '</body></opml>' AS document, count(*) AS n_outlines
  FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1""")
def opml_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, read back by an XML parser for their number of outlines."""
    f = _opml_feeds(spark, d)
    docs = export.opml_documents(export.opml_outlines(f).join(f.select("feed_id", "s_nationkey"), "feed_id"), ["s_nationkey"], F.lit("2024-05-01 10:00:00").cast("timestamp"))
    return docs.withColumn("n_outlines", F.size(F.from_xml("document", "body struct<outline array<struct<_xmlUrl string>>>")["body"]["outline"]).cast("long"))


AGGREGATES = "SELECT o_custkey AS page_id, count(*) FILTER (o_orderstatus = 'F') AS n_live_rss, count(*) FILTER (o_orderpriority LIKE '1%') AS n_api, count(*) FILTER (o_orderpriority LIKE '1%' AND o_totalprice > 200000) AS n_strong_api, bool_or(o_totalprice > 450000) AS has_js FROM orders GROUP BY 1"


@query(f"SELECT page_id, n_live_rss = 0 AND (has_js OR n_api = 0) AS needs_browser, CASE WHEN n_live_rss > 0 THEN 'rss' WHEN n_api = 1 AND n_strong_api = 1 THEN 'json_api' END AS strategy FROM ({AGGREGATES})")
def strategy_gate(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("o_orderpriority").startswith("1")
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_live_rss"), F.count_if(first).alias("n_api"), F.count_if(first & (F.col("o_totalprice") > 200_000)).alias("n_strong_api"), F.max(F.col("o_totalprice") > 450_000).alias("has_js"))
    return I.gate(a.withColumn("forced", F.lit(False)).withColumn("anti_bot", F.lit(False))).select("page_id", "needs_browser", "strategy")


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'xpath' END AS strategy, CASE c_custkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS confidence, CASE WHEN c_custkey % 4 < 2 THEN 2 END AS n_caveats,
  CASE c_custkey % 4 WHEN 2 THEN 'unknown strategy: magic' WHEN 3 THEN 'reply is not JSON' END AS error FROM customer""")
def llm_validate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, '{"strategy":"rss","confidence":1.7,"caveats":["a","b"]}').when(k == 1, '{"strategy":"xpath","confidence":"high","caveats":["a","b"]}').when(k == 2, '{"strategy":"magic","confidence":0.5}').otherwise("no idea {")
    return I.checked_replies(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("reply")), "id")


@query("SELECT doc_id, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || chr(10) || '...and ' || (length(text) - 3000) || ' more' ELSE text END AS summary FROM documents")
def prompt_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", I.capped_text(F.col("text"), F.length("text") - 3_000).alias("summary"))


# ---- entry points ----


@query(f"""SELECT o_custkey AS config_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, {TITLE_SQL} AS title, CASE WHEN o_custkey % 6 = 3 THEN 'https://c' || o_custkey || '.example.com' ELSE '' END || '/orders/' || o_orderkey AS link
  FROM orders WHERE o_custkey % 6 < 4 AND (o_custkey % 6 <> 3 OR o_orderkey % 5 <> 0) QUALIFY ord < 100""")
def scrape_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _scraped(spark, d)[0].where("ord < 100").select("config_id", "ord", "title", "link")


@query("""SELECT o_custkey AS config_id, ['rss', 'json_api', 'embedded_json', 'xpath', 'rss_bridge', 'rss'][o_custkey % 6 + 1] AS strategy, CASE WHEN o_custkey % 6 < 3 THEN count(*) WHEN o_custkey % 6 = 3 THEN count(*) FILTER (o_orderkey % 5 <> 0) ELSE 0 END AS item_count,
  CASE o_custkey % 6 WHEN 4 THEN 'unsupported strategy: rss_bridge' WHEN 5 THEN 'HTTP 404' END AS error FROM orders GROUP BY 1""")
def scrape_runs(spark: SparkSession, d: str) -> DataFrame:
    return _scraped(spark, d)[1]


def _scraped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from ..api import scrape

    k = F.col("cust") % 6
    bodies = R.feeds_xml(spark, d, "atom").where(k.isin(0, 5)).union(R.json_payloads(spark, d).where(k == 1).select("cust", "body")).union(R.embedded_pages(spark, d).where(k == 2)).union(R.html_lists(spark, d).withColumnRenamed("page_id", "cust").where(k.isin(3, 4)).select("cust", "html"))
    url = F.concat(F.lit("https://c"), F.col("cust").cast("string"), F.lit(".example.com/"))
    responses = bodies.select(url.alias("url"), F.when(k == 5, 404).otherwise(200).alias("status"), "body")
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    strategies = F.array(*map(F.lit, ["rss", "json_api", "embedded_json", "xpath", "rss_bridge", "rss"]))
    configs = table(spark, d, "orders").select(F.col("o_custkey").alias("cust")).distinct().select(
        F.col("cust").alias("config_id"), url.alias("url"), F.element_at(strategies, (k + 1).cast("int")).alias("strategy"),
        F.when(k == 1, "data.posts").when(k == 3, BLOCKS).otherwise("").alias("item"),
        F.when(k == 3, pairs(FIELDS)).otherwise(pairs({"title": "title", "link": "url"})).alias("fields"), F.lit(None).cast("int").alias("max_items"),
    )
    return scrape(configs, responses)


@query()
def discover_pages(spark: SparkSession, d: str) -> DataFrame:
    from ..api import discover

    pages = large(R.html_lists(spark, d)).join(R.embedded_pages(spark, d).select(F.col("cust").alias("page_id"), F.col("html").alias("more")), "page_id")
    return discover(pages.select("page_id", F.lit("https://c.example.com/").alias("url"), F.concat("html", "more").alias("html")), R.captures(spark, d).withColumnRenamed("cust", "page_id"))


@query(f"""SELECT config_id, count(*) AS n_entries, count(*) AS n_complete, 'feed:' || config_id AS id, '2024-05-01T10:00:00Z' AS updated, 'https://c' || config_id || '.example.com/' AS link
  FROM (SELECT o_custkey AS config_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey % 6 < 3 OR (o_custkey % 6 = 3 AND o_orderkey % 5 <> 0)) WHERE k <= CASE WHEN config_id % 6 IN (0, 3) THEN 100 ELSE 5000 END GROUP BY 1""")
def atom_documents(spark: SparkSession, d: str) -> DataFrame:
    """Atom documents of all configs, read back by an XML parser: entries, those with all required elements, and the feed's own."""
    from ..api import export_atom

    found = _scraped(spark, d)[0].where(F.col("ord") < F.when((F.col("config_id") % 6).isin(0, 3), 100).otherwise(5_000))
    k = F.col("config_id").cast("string")
    docs = export_atom(found, found.select("config_id", F.concat(F.lit("Feed <"), k, F.lit(">")).alias("name"), F.concat(F.lit("https://c"), k, F.lit(".example.com/")).alias("url")).distinct(), F.lit("2024-05-01 10:00:00").cast("timestamp"))
    x = F.from_xml("document", "id string, updated string, link struct<_href string>, entry array<struct<id string, title string, updated string>>")
    complete = F.filter("x.entry", lambda e: e["id"].isNotNull() & e["title"].isNotNull() & e["updated"].isNotNull())
    return docs.select("config_id", x.alias("x")).select("config_id", F.size("x.entry").cast("long").alias("n_entries"), F.size(complete).cast("long").alias("n_complete"), "x.id", "x.updated", F.col("x.link._href").alias("link"))


@query("SELECT feed_id, streak, name FROM (SELECT c_custkey AS feed_id, CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE 0 END AS streak, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS name FROM customer) WHERE feed_id % 10 <> 0")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import stores

    feeds = table(spark, d, "customer").select(F.col("c_custkey").alias("feed_id"), F.lit(0).alias("streak"), F.col("c_name").alias("name"))
    changes = feeds.where("feed_id % 3 = 0").select("feed_id", F.explode(F.array(F.lit(8), F.lit(9))).alias("streak"), F.lit("changed").alias("name")).withColumn("at", F.col("streak"))
    return stores.delete(stores.upsert(feeds, changes, "feed_id", "at"), feeds.where("feed_id % 10 = 0").select("feed_id"), "feed_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 50 ELSE 7 END AS max_pages, CASE WHEN length(c_name) <= 12 THEN '…' ELSE substr(c_name, 1, 4) || '…' END || substr(c_name, length(c_name) - 3, 4) AS masked FROM customer")
def form_values(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import stores

    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "none").when(k == 1, "900").otherwise("7")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), stores.form_number(text, 1, 50, 1).alias("max_pages"), S.mask_secret(F.col("c_name")).alias("masked"))


from . import machines, more, proposals, readers, repair, stores  # noqa: E402, F401  (further queries, registered by their import)
