"""Further queries: selectors from examples, previews and filters, stores and forms, prompts and checked replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_walk as J
from ..functions import scalars as S
from ..operators import items as I
from ..operators import preview as P
from ..operators import prune, selectors, stores
from ..sources import documents as D
from ..sources.dom import nodes, shared
from . import render as R
from .queries import BLOCKS, FIELDS, TITLE_SQL, query
from .render import table

# ---- selectors from examples ----

CARDS = "SELECT o_custkey AS page_id, count(*) FILTER (o_orderkey % 5 <> 0) AS cards, count(*) FILTER (o_orderkey % 5 = 0) AS featured, count(*) AS n, min(o_orderkey) AS first, min(o_orderkey) FILTER (o_orderkey % 5 <> 0) AS first_card, min(o_orderkey) FILTER (o_orderkey % 5 = 0) AS first_featured FROM orders GROUP BY 1"
CARD, FEATURED = "//article[contains(@class,''post-card'')]", "//article[contains(@class,''featured'')]"


def _first_titles(spark: SparkSession, d: str) -> DataFrame:
    return R.order_items(spark, d).groupBy(F.col("cust").alias("page_id")).agg(F.min_by("title", "key").alias("needle"))


@query(f"SELECT page_id, './/h2' AS title, './/a/@href' AS link, './/time/@datetime' AS timestamp, 'descendant::h2' AS guessed_title FROM ({CARDS}) WHERE greatest(cards, featured) >= 3")
def derived_fields(spark: SparkSession, d: str) -> DataFrame:
    """The field selectors of a date anchor's first item."""
    return selectors.derived_fields(R.html_lists(spark, d))


@query(f"SELECT page_id, 1 AS rank, CASE WHEN first % 5 = 0 THEN '{FEATURED}' ELSE '{CARD}' END AS selector FROM ({CARDS}) WHERE n >= 2")
def reanchored(spark: SparkSession, d: str) -> DataFrame:
    return selectors.reanchor(R.html_lists(spark, d), _first_titles(spark, d))


@query("SELECT o_custkey AS page_id, count(*) AS n, (max(i))::INT AS last_index FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 = 0 ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY 1")
def sibling_places(spark: SparkSession, d: str) -> DataFrame:
    n = selectors.sibling_index(nodes(R.html_lists(spark, d), "pre", "parent", "tag", "cls", "elem_id", "role", tags=["article"]))
    return n.groupBy("page_id").agg(F.count("*").alias("n"), F.max("sibling_index").alias("last_index"))


@query(f"SELECT page_id, '//html/body/main[contains(@class,''post-list'')]/article[contains(@class,''' || CASE WHEN first % 5 = 0 THEN 'featured' ELSE 'post-card' END || ''')]/h2[contains(@class,''post-card__title'')]/a' AS selector, (CASE WHEN first % 5 = 0 THEN featured ELSE cards END)::INT AS sibling_count FROM ({CARDS})")
def recovered_selectors(spark: SparkSession, d: str) -> DataFrame:
    """From a title in other case and with other blanks, the selector of all titles of its kind."""
    pages = R.html_lists(spark, d)
    examples = _first_titles(spark, d).select("page_id", F.upper(F.replace("needle", F.lit(" "), F.lit("  "))).alias("needle"))
    n = shared(nodes(pages, *selectors.STACK_COLUMNS))
    exact = selectors.recovered_selectors(pages, n, examples, least=0.999)
    return exact


@query(f"SELECT page_id, unnest(['content', 'title']) AS field, 1 AS rank, unnest(['.//p[contains(@class,''summary'')]', './/h2']) AS path, (CASE WHEN first % 5 = 0 THEN featured ELSE cards END)::INT AS hits FROM ({CARDS})")
def recovered_fields(spark: SparkSession, d: str) -> DataFrame:
    pages = R.html_lists(spark, d)
    o = R.order_items(spark, d).groupBy(F.col("cust").alias("page_id")).agg(F.min_by(F.struct("title", "price", "key"), "key").alias("i"))
    content = F.concat(F.lit("Priced at "), F.col("i.price").cast("string"), F.lit(" in all, thank youfor the order"))
    examples = o.select("page_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("i.title").alias("needle")), F.struct(F.lit("content").alias("field"), content.alias("needle")))).alias("e")).select("page_id", "e.*")
    blocks = nodes(pages, "pre", "last", "cls", tags=["article"]).groupBy("page_id").agg(F.min_by(F.struct("pre", "last", "cls"), "pre").alias("b"))
    items = blocks.select("page_id", F.when(F.col("b.cls") == "featured", "//article[@class='featured']").otherwise(BLOCKS).alias("item"), "b.pre", "b.last")
    return selectors.recovered_fields(pages, items, examples, least=0.999)


@query(f"SELECT page_id, unnest([0, 1]) AS k, unnest([cards = 0, true]) AS poor, unnest([cards > 0, false]) AS good FROM ({CARDS})")
def match_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page's first three cards hold an example: the title of the first does (where there is a card), a text from nowhere does not."""
    from ..operators import xpath

    got = shared(xpath.scan(R.html_lists(spark, d), BLOCKS, {"title": FIELDS["title"]}))  # two checks read it
    firsts = R.order_items(spark, d).groupBy(F.col("cust").alias("page_id")).agg(F.coalesce(F.min_by(F.when(F.col("key") % 5 != 0, F.col("title")), F.when(F.col("key") % 5 != 0, F.col("key"))), F.lit("no cards on this page")).alias("t"))
    ex = firsts.select("page_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.upper("t").alias("needle")), F.struct(F.lit(1).alias("k"), F.lit("absent from all pages").alias("needle")))).alias("e")).select("page_id", "e.*")
    poor = selectors.poor_match(got.select("page_id", "ord", F.col("title").alias("text")), ex, "page_id").join(ex, ["page_id", "needle"])
    values = got.select("page_id", "ord", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("field"), F.col("title").alias("value"))
    good = selectors.already_good(values, ex.withColumn("field", F.col("k").cast("string")), "page_id")
    return poor.select("page_id", "k", "poor").join(good.select("page_id", F.col("field").cast("int").alias("k"), "good"), ["page_id", "k"])


def _example_rows(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The first block of each class as a row of examples: title and price, and more fields by their names (link)."""
    o = R.order_items(spark, d).withColumn("row", (F.col("key") % 5 == 0).cast("int"))
    first = o.groupBy(F.col("cust").alias("page_id"), "row").agg(F.min_by(F.struct("title", "url", "price"), "key").alias("i"))
    price = F.concat(F.lit("Priced at "), F.col("i.price").cast("string"), F.lit(" in"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("needle")) for f, c in (("title", F.col("i.title")), ("content", price), ("link", F.col("i.url"))) if f != "link" or f in more])
    return first.select("page_id", "row", F.explode(cells).alias("e")).select("page_id", "row", "e.*")


ROWS_SQL = f"SELECT page_id, row, n, CASE WHEN n < 2 THEN '//html' WHEN row = 0 THEN '{CARD}' ELSE '{FEATURED}' END AS selector FROM (SELECT page_id, unnest([0, 1]) AS row, unnest([cards, featured]) AS n FROM (SELECT page_id, cards, featured FROM ({CARDS})))"
CONF = "(20 + 3 * least(n, 10) + CASE WHEN n >= 3 THEN 20 WHEN n >= 2 THEN 10 ELSE 2 END)"
CONF_3 = CONF.replace("(20 +", "(30 +")  # of three fields


@query(f"SELECT page_id, CAST(row AS INT) AS row, selector, n AS item_count, 2 AS n_fields, {CONF} / 100.0::DOUBLE AS confidence, './/p[contains(@class,''summary'')]' AS content, './/h2[contains(@class,''post-card__title'')]' AS title FROM ({ROWS_SQL}) WHERE n >= 1")
def row_anchors(spark: SparkSession, d: str) -> DataFrame:
    a = selectors.row_anchors(R.html_lists(spark, d), _example_rows(spark, d))
    return a.select("page_id", "row", "selector", "item_count", "n_fields", "confidence", F.col("fields")["content"].alias("content"), F.col("fields")["title"].alias("title"))


@query(f"SELECT page_id, string_agg(selector, ' | ' ORDER BY row) AS selector, sum(n)::BIGINT AS item_count, floor(avg({CONF_3}) + 0.5) / 100.0::DOUBLE AS confidence, './/h2[contains(@class,''post-card__title'')]' AS title, count(*) AS n_families FROM ({ROWS_SQL}) WHERE n >= 2 GROUP BY 1")
def multi_row_anchor(spark: SparkSession, d: str) -> DataFrame:
    a = selectors.families(selectors.row_anchors(R.html_lists(spark, d), _example_rows(spark, d, "link")))
    return a.select("page_id", "selector", "item_count", "confidence", F.col("fields")["title"].alias("title"), "n_families")


@query(f"SELECT page_id, CAST(family AS INT) AS family, (row_number() OVER (PARTITION BY page_id ORDER BY family, o_orderkey))::INT AS rank, {TITLE_SQL} AS title FROM (SELECT o_custkey AS page_id, o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS family, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 = 0 ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 2")
def family_samples(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(R.html_lists(spark, d), "pre", "tag", "cls", "text").where("tag = 'article'")
    hit = n.select("page_id", "pre", F.regexp_extract("text", r"^(Order \d+ & .*?)\d{4}-\d{2}-\d{2}", 1).alias("text"), F.when(F.contains("cls", F.lit("post-card")), 0).otherwise(1).alias("family"))
    return selectors.family_samples(hit).select("page_id", "family", "rank", F.col("text").alias("title"))


# ---- skeletons ----

DOC = "'<html><body><main class=\"m\"><p id=\"k' || s_suppkey || '\">'"


def _supplier_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit('<html><body><main class="m" data-x="1"><p id="k'), k, F.lit('">one <b>two three</b> four five</p><font>lifted <i>text</i></font><!-- no --><script>x</script> tail</main><nav class="n">menu words <a href="/'), k, F.lit('">go</a></nav><p class="byline">by me</p></body></html>')).alias("html"))


@query(f"SELECT s_suppkey AS page_id, {DOC} || '[text:1]<b>[text:2]</b>[text:2]</p><font>[text:1]<i>[text:1]</i></font>[text:1]</main><nav class=\"n\">[text:2]<a href=\"/' || s_suppkey || '\">go</a></nav></body></html>' AS skeleton FROM supplier")
def skeleton_markup(spark: SparkSession, d: str) -> DataFrame:
    return prune.skeletons(nodes(_supplier_pages(spark, d), *prune.PRUNE_COLUMNS))


@query(f"SELECT s_suppkey AS page_id, {DOC} || 'one <b>two three</b> four five</p><font>lifted <i>text</i></font> tail</main><nav class=\"n\">[text:2]<a href=\"/' || s_suppkey || '\">go</a></nav><p class=\"byline\">[text:2]</p></body></html>' AS skeleton FROM supplier")
def text_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return prune.text_skeletons(nodes(_supplier_pages(spark, d), *prune.PRUNE_COLUMNS))


@query("SELECT s_suppkey AS page_id, '<html><body><main class=\"m\"><p id=\"k' || s_suppkey || '\">one <b>two three</b> four five</p><font>lifted <i>text</i></font></main><nav class=\"n\">menu words <a href=\"/' || s_suppkey || '\">go</a></nav><p class=\"byline\">by me</p></body></html>' AS snippet FROM supplier")
def anchored_snippet(spark: SparkSession, d: str) -> DataFrame:
    pages = _supplier_pages(spark, d)
    return prune.anchored_snippets(shared(nodes(pages, *prune.PRUNE_COLUMNS, "parent", "text", "path")), pages.select("page_id", F.lit("Two  Three").alias("needle")))


# ---- scans of scripts and endpoints ----


@query("SELECT o_orderkey AS script_id, '/api/orders/' || o_orderkey AS url, '' AS path, 2 AS n_items, 0.68::DOUBLE AS score FROM orders WHERE o_orderkey % 3 = 0")
def api_probe(spark: SparkSession, d: str) -> DataFrame:
    """API-like URLs in scripts, joined to what they returned: JSON with items, an error, or no JSON."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    scripts = o.select(k.alias("script_id"), F.concat(F.lit('fetch("/api/orders/'), k.cast("string"), F.lit('")')).alias("js"))
    body = '[{"title":"a","url":"/a","date":"2024-01-01","image":"x"},{"title":"b","url":"/b","date":"2024-01-02","image":"y"}]'
    got = o.select(F.concat(F.lit("/api/orders/"), k.cast("string")).alias("url"), F.lit("GET").alias("method"), F.when(k % 3 == 1, 404).otherwise(200).alias("status"), F.when(k % 3 == 2, "text/html").otherwise("application/json; charset=utf-8").alias("content_type"), F.lit(body).alias("body"))
    found = D.probed_apis(D.api_urls(scripts, "script_id"), "script_id", got)
    return found.select("script_id", "url", "path", "n_items", (F.col("score")).cast("double").alias("score"))


@query("""SELECT page_id, pos, src FROM (SELECT c_custkey AS page_id, i::INT AS pos, 'https://c' || c_custkey || '.example.com/' || CASE i % 2 WHEN 0 THEN 'dir/' ELSE '' END || i || '.js' AS src, length(c_name) AS len
  FROM customer, range(9) t(i)) WHERE pos <> 4 AND (page_id + pos) % 3 <> 0 AND NOT (page_id % 7 = 0 AND pos < 5) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 5""")
def own_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The first five same-origin scripts that were fetched: others fail, are on another host or, on every seventh page, too long."""
    k, at = F.col("c_custkey"), F.sequence(F.lit(0), F.lit(8))
    src = F.transform(at, lambda i: F.when(i == 4, "https://cdn.example.com/lib.js").when(i % 2 == 0, F.concat(i.cast("string"), F.lit(".js"))).otherwise(F.concat(F.lit("/"), i.cast("string"), F.lit(".js"))))
    html = F.array_join(F.transform(src, lambda u: F.concat(F.lit("<script async src='"), u, F.lit("'></script>"))), "")
    pages = table(spark, d, "customer").select(k.alias("page_id"), F.concat(F.lit("https://c"), k.cast("string"), F.lit(".example.com/dir/x")).alias("url"), html.alias("html"))
    got = pages.select("page_id", "url", F.posexplode(src).alias("i", "s")).select(
        F.when(F.col("i") == 4, F.col("s")).when(F.col("i") % 2 == 0, F.concat(F.lit("https://c"), F.col("page_id").cast("string"), F.lit(".example.com/dir/"), "s")).otherwise(F.concat(F.lit("https://c"), F.col("page_id").cast("string"), F.lit(".example.com"), "s")).alias("url"),
        F.when((F.col("page_id") + F.col("i")) % 3 == 0, 404).otherwise(200).alias("status"),
        F.repeat(F.lit("x"), F.when((F.col("page_id") % 7 == 0) & (F.col("i") < 5), 60).otherwise(20)).alias("body"),
    ).distinct()
    return D.own_scripts(pages, "page_id", "url", responses=got, longest=50).select("page_id", "pos", "src")


@query("SELECT c_custkey AS site, 'latestPosts' AS field, 'Post' AS type, 1 AS rank, 'data.latestPosts' AS path, 3 AS n_items FROM customer")
def introspection(spark: SparkSession, d: str) -> DataFrame:
    """List fields of a GraphQL schema that name feed words, and the replies to their queries."""
    schema = '{"data":{"__schema":{"queryType":{"fields":[{"name":"me","type":{"kind":"OBJECT","name":"User"}},{"name":"latestPosts","type":{"kind":"NON_NULL","ofType":{"kind":"LIST","ofType":{"kind":"OBJECT","name":"Post"}}}},{"name":"tags","type":{"kind":"LIST","ofType":{"kind":"OBJECT","name":"Tag"}}}]}}}}'
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("site"))
    found = D.introspected_queries(sites.withColumn("body", F.lit(schema)), "site")
    replies = sites.select("site", F.lit("latestPosts").alias("field"), F.lit('{"data":{"latestPosts":[{"title":"a","url":"/a"},{"title":"b","url":"/b"},{"title":"c","url":"/c"}]}}').alias("body"))
    kept = D.replayed_queries(found, "site", replies)
    return found.join(kept, ["site", "field"]).select("site", "field", "type", "rank", "path", "n_items")


@query("SELECT c_custkey AS site, 'Two' AS title, 'https://x.example.com/' || c_custkey AS link, '<p>full</p>' AS content, '2024-02-0' || (c_custkey % 9 + 1) AS timestamp, 'Ann' AS author FROM customer")
def feed_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Atom with a self link first, RSS 2.0 with module elements, and RDF items give the same item."""
    k = F.col("c_custkey")
    day = F.concat(F.lit("2024-02-0"), (k % 9 + 1).cast("string"))
    link = F.concat(F.lit("https://x.example.com/"), k.cast("string"))
    rss = F.concat(F.lit("<item><title>Two</title><link>"), link, F.lit("</link><description>short</description><content:encoded>&lt;p&gt;full&lt;/p&gt;</content:encoded><dc:creator>Ann</dc:creator><dc:date>"), day, F.lit("</dc:date></item>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title><link rel="self" href="/self"/><link rel="enclosure" href="/e.mp3"/><link rel="alternate" href="'), link, F.lit('"/><updated>'), day, F.lit("</updated><content>&lt;p&gt;full&lt;/p&gt;</content><author><name>Ann</name></author></entry></feed>"))
    space = 'xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    c = table(spark, d, "customer").select(k.alias("site"), F.when(k % 3 == 0, atom).when(k % 3 == 1, F.concat(F.lit(f"<rss version='2.0' {space}><channel>"), rss, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit(f"<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' {space}><channel><title>c</title></channel>"), rss, F.lit("</rdf:RDF>"))).alias("body"))
    both = D.atom_items(c.where("site % 3 = 0"), "site").union(D.rss_items(c.where("site % 3 <> 0"), "site"))
    return both.select("site", "title", "link", "content", "timestamp", "author")


@query("SELECT c_custkey AS page_id, unnest(['https://c' || c_custkey || '.example.com/blog/feed.xml', 'https://feeds.example.com/' || c_custkey]) AS feed_url FROM customer")
def feed_links(spark: SparkSession, d: str) -> DataFrame:
    """Linked feeds: relative and protocol-relative addresses are resolved against the page."""
    k = F.col("c_custkey").cast("string")
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://c"), k, F.lit(".example.com/blog/home")).alias("url"), F.concat(F.lit("<link rel='alternate' type='application/rss+xml' href='feed.xml'><link rel='alternate' type='application/atom+xml' href='//feeds.example.com/"), k, F.lit("'>")).alias("html"))
    return D.feed_candidates(pages, "page_id", "url").where("source = 'link'").select("page_id", "feed_url")


# ---- previews, filters, debugging ----


@query("SELECT o_custkey AS site, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, " + TITLE_SQL + " AS title, o_orderstatus AS content, o_custkey % 7 <> 0 AS cached FROM orders QUALIFY ord < 10 AND o_custkey % 7 <> 0")
def cached_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first entries of cached feeds; feeds without any are left to a new scrape."""
    cached = R.feeds_xml(spark, d, "atom").select(F.col("cust").alias("site"), F.when(F.col("cust") % 7 == 0, "<feed></feed>").otherwise(F.col("body")).alias("body"))
    return P.cached_items(cached, "site").withColumn("cached", F.lit(True)).select("site", "ord", "title", "content", "cached")


@query("SELECT o_custkey AS site FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1")
def uncached_feeds(spark: SparkSession, d: str) -> DataFrame:
    cached = R.feeds_xml(spark, d, "atom").select(F.col("cust").alias("site"), F.when(F.col("cust") % 7 == 0, "<feed></feed>").otherwise(F.col("body")).alias("body"))
    return P.needs_scrape(cached).select("site")


@query("SELECT page_id, substr(html, 1, 12000) AS sample FROM pages")
def source_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.source_sample(table(spark, d, "pages"), "page_id", "html")


KINDS = "SELECT p_partkey AS id, p_partkey // 10 AS page_id, ['rss', 'api', 'embedded'][p_partkey % 3 + 1] AS kind, p_partkey % 7 AS item_count, (p_partkey % 11) / 10.0::DOUBLE AS score, p_partkey % 2 = 0 AS is_alive FROM part"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.floor(k / 10).alias("page_id"), F.element_at(F.array(F.lit("rss"), F.lit("api"), F.lit("embedded")), (k % 3 + 1).cast("int")).alias("kind"), (k % 7).alias("item_count"), ((k % 11) / 10.0).cast("double").alias("score"), (k % 2 == 0).alias("is_alive"))


@query(f"SELECT id FROM ({KINDS}) WHERE (kind = 'rss' AND is_alive) OR (kind = 'api' AND (item_count >= 3 OR score >= 0.3)) OR (kind = 'embedded' AND item_count >= 3)")
def useful_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.useful(_candidates(spark, d)).select("id")


@query(f"SELECT id, k = 1 OR (score >= 0.7 AND k <= 3) AS auto_preview FROM (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY score DESC, id) AS k FROM ({KINDS}))")
def auto_preview(spark: SparkSession, d: str) -> DataFrame:
    return P.auto_preview(_candidates(spark, d), ["page_id", "kind"], "id").select("id", "auto_preview")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS title, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS content FROM documents")
def display_cuts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.cut(F.col("text"), 80).alias("title"), P.cut(F.col("text"), 120).alias("content"))


@query("SELECT page_id, CASE WHEN length(url) <= 60 THEN url ELSE regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) || '…' || right(url, 25) END AS shown FROM pages")
def display_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", P.short_link(F.col("url")).alias("shown"))


@query("SELECT o_custkey AS cust, '{\"n\":' || count(*) || ',\"first\":\"/orders/' || min(o_orderkey) || '\"}' AS response FROM orders GROUP BY 1")
def scrape_json(spark: SparkSession, d: str) -> DataFrame:
    """A scrape's answer as JSON, one document a config."""
    from .queries import json_items

    return P.as_json(json_items(spark, d).groupBy("cust").agg(F.count("*").alias("n"), F.min_by("link", "ord").alias("first")), "cust")


@query("SELECT feed_id, name FROM (SELECT c_custkey AS feed_id, c_name AS name FROM customer ORDER BY c_custkey DESC LIMIT 3)")
def recent_feeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("feed_id"), F.col("c_name").alias("name")).orderBy(F.desc("feed_id")).limit(3)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ref' ELSE 'first' END AS chosen FROM customer")
def referenced_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The candidate that a model's reply names, by either text holding the other; else the first."""
    k = F.col("c_custkey")
    refs = table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 0, "use //li[@class='b'] please").otherwise("none of them").alias("ref"))
    cands = refs.select("id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("//li[@class='a']").alias("selector"), F.lit("first").alias("name")), F.struct(F.lit(1).alias("ord"), F.lit("//li[@class='b']").alias("selector"), F.lit("ref").alias("name")))).alias("c")).select("id", "c.*")
    return P.referenced(refs, cands, "id").select("id", F.col("name").alias("chosen"))


# ---- stores, forms, settings ----


@query("SELECT c_custkey AS feed_id, CASE WHEN c_custkey % 3 = 0 THEN 'json_api' ELSE 'rss' END AS strategy, CASE WHEN c_custkey % 2 = 0 THEN '1h' ELSE '1d' END AS cadence FROM customer WHERE c_custkey % 11 <> 0")
def store_migrate(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents: broken ones are left out, missing values and old names are filled in."""
    k = F.col("c_custkey")
    line = F.when(k % 11 == 0, "broken {").otherwise(F.concat(F.lit('{"feed_id":"'), k.cast("string"), F.lit('","strategy":"'), F.when(k % 3 == 0, "json").otherwise("rss"), F.lit('"'), F.when(k % 2 == 0, ',"cadence":"1h"').otherwise(""), F.lit("}")))
    rows = stores.parsed_store(table(spark, d, "customer").select(line.alias("line")), "line", "feed_id string, strategy string, cadence string")
    return stores.migrate_feeds(rows).select(F.col("feed_id").cast("long").alias("feed_id"), "strategy", "cadence")


@query("SELECT id, CAST(row AS INT) AS row, field, value FROM (SELECT c_custkey AS id, unnest([0, 0, 1]) AS row, unnest(['title', 'link', 'title']) AS field, unnest(['A' || c_custkey, '/x', 'B']) AS value FROM customer)")
def form_examples(spark: SparkSession, d: str) -> DataFrame:
    """A form's lists of examples as rows; a single example of the old kind joins its list."""
    k = F.col("c_custkey").cast("string")
    form = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.concat(F.lit(" A"), k), F.lit("B ")).alias("title"), stores.fold_example(F.array().cast("array<string>"), F.lit("/x")).alias("link"))
    return stores.example_rows(form, "id", ["title", "link"])


@query("SELECT c_custkey AS owner, unnest(['base_url', 'timeout']) AS name, unnest(['https://h.example.com', CASE WHEN c_custkey % 2 = 0 THEN '60' ELSE '30' END]) AS value FROM customer")
def settings_update(spark: SparkSession, d: str) -> DataFrame:
    """Settings with changes: known names only, service URLs without their last slashes."""
    k = F.col("c_custkey")
    owners = table(spark, d, "customer").select(k.alias("owner"))
    now = owners.select("owner", F.explode(F.create_map(*map(F.lit, ["base_url", "https://old.example.com", "timeout", "30"]))).alias("name", "value"))
    changes = owners.select("owner", F.explode(F.map_concat(F.create_map(*map(F.lit, ["base_url", "https://h.example.com//", "unknown", "x"])), F.when(F.col("owner") % 2 == 0, F.create_map(F.lit("timeout"), F.lit("60"))).otherwise(F.create_map(F.lit("other"), F.lit("1"))))).alias("name", "value"))
    out = stores.update_settings(now, changes, ["base_url", "timeout"], ["owner"])
    return out.select("owner", "name", F.when(F.col("name") == "base_url", stores.service_url(F.col("value"))).otherwise(F.col("value")).alias("value"))


@query("SELECT user_id AS page, max(event_id) AS event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 604800 GROUP BY 1")
def cache_store(spark: SparkSession, d: str) -> DataFrame:
    """The discovery cache: what has expired goes, then new entries replace those of their page."""
    e = table(spark, d, "events").select(F.col("user_id").alias("page"), "event_id", "ts")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    now = e.agg(F.max("ts").alias("now"))
    return stores.store_cache(old.join(F.broadcast(now)), new.join(F.broadcast(now)), "page", "ts", F.col("now"), 604_800, "event_id").select("page", "event_id")


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4096 THEN substr(text, 1, 2048) ELSE text END AS artifact, octet_length(encode(text)) > 4096 AS truncated FROM documents")
def trace_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of traces: what is too long is cut (at 4 KiB here, at 2 MiB by default)."""
    return table(spark, d, "documents").select("doc_id", P.artifact(F.col("text"), 4_096, 2_048).alias("artifact"), (F.octet_length("text") > 4_096).alias("truncated"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'item_path' WHEN 1 THEN 'item_selector' ELSE 'path' END AS item_key, '//li' AS item, CASE WHEN c_custkey % 3 = 0 THEN 'GET' END AS method FROM customer")
def flat_recipe(spark: SparkSession, d: str) -> DataFrame:
    """A stored config as the flat recipe of its strategy."""
    k = F.col("c_custkey") % 3
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 0, "json_api").when(k == 1, "xpath").otherwise("embedded_json").alias("strategy"), F.create_map(*map(F.lit, ["item", "//li", "item_title", ".//b"])).alias("selectors"), F.lit("").alias("method"))
    r = stores.flat_recipe(F.col("strategy"), F.col("selectors"), F.col("method"))
    return c.select("id", r.alias("r")).select("id", F.map_keys("r")[0].alias("item_key"), F.map_values("r")[0].alias("item"), F.col("r")["method"].alias("method"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'chrome' ELSE 'plain' END AS backend, c_custkey % 2 = 0 AS stealth FROM customer")
def overlaid_config(spark: SparkSession, d: str) -> DataFrame:
    """A config with the overrides of its feed laid over it, where these say anything."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), F.lit("plain").alias("backend"), F.lit(False).alias("stealth"))
    o = table(spark, d, "customer").select(k.alias("id"), F.when(k % 2 == 0, "chrome").otherwise("").alias("backend"), F.when(k % 2 == 0, True).alias("stealth"))
    return stores.overlay(c, o, "id", ["backend", "stealth"])


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AS short_id, true AS long_id FROM customer")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.repeat(F.lit("x"), F.when(F.col("c_custkey") % 2 == 0, 64).otherwise(128))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), stores.is_safe_id(name).alias("short_id"), stores.is_safe_id(name, 128).alias("long_id"))


# ---- JSON samples, prompts, replies ----

LONG = "repeat('x', (200 + p_partkey % 3)::INT)"


@query(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN {LONG} ELSE repeat('x', 200) || '…' END AS title, '<list len=2>' AS tags, '<dict len=1>' AS meta, 10::BIGINT AS n_keys FROM part")
def sample_trim(spark: SparkSession, d: str) -> DataFrame:
    more = "".join(f',"k{k}":{k}' for k in range(12))
    item = F.concat(F.lit('{"title":"'), F.repeat(F.lit("x"), (F.col("p_partkey") % 3 + 200).cast("int")), F.lit(f'","tags":[1,2],"meta":{{"a":1}}{more}}}'))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.trimmed_sample(item).alias("s"))
    return t.select("id", F.col("s")["title"].alias("title"), F.col("s")["tags"].alias("tags"), F.col("s")["meta"].alias("meta"), F.size("s").cast("long").alias("n_keys"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 300 ELSE 201 END AS n_text, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 5 END AS n_list FROM part")
def json_trim(spark: SparkSession, d: str) -> DataFrame:
    """JSON of some thousand characters stays; of what is longer, strings and arrays are cut at every depth."""
    k = F.col("p_partkey") % 2
    body = F.concat(F.lit('{"a":{"t":"'), F.repeat(F.lit("y"), F.lit(300)), F.lit('","l":[1,2,3,4,5,6,7,8,9]},"pad":"'), F.repeat(F.lit("z"), F.when(k == 0, 10).otherwise(9_000)), F.lit('"}'))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), J.trimmed()(body).alias("j"))
    return t.select("id", F.length(F.get_json_object("j", "$.a.t")).alias("n_text"), F.json_array_length(F.get_json_object("j", "$.a.l")).alias("n_list"))


@query("SELECT p_partkey AS id, 9 AS depth FROM part")
def json_clip(spark: SparkSession, d: str) -> DataFrame:
    """Values deeper than eight levels become text."""
    deep = F.concat(F.lit('{"a":' * 12), F.col("p_partkey").cast("string"), F.lit("}" * 12))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), J.clipped(deep).alias("j"))
    return t.select("id", F.regexp_count(F.split(F.col("j"), "'")[0], F.lit('"a"')).alias("depth"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE 'rss' END AS strategy, CASE c_custkey % 3 WHEN 2 THEN 'reply is not JSON' END AS error FROM customer")
def prose_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies with prose around their JSON."""
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, 'Sure! {"strategy":"rss","confidence":0.5,"caveats":["use } carefully"]} Hope it helps {x}').when(k == 1, '{"strategy":"rss"}').otherwise("I do not know {")
    return I.checked_replies(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("reply")), "id").select("id", "strategy", "error")


@query("SELECT c_custkey AS id, 'data.posts' AS item_path, 'url' AS link, 1 AS n_fields, 2 AS n_caveats FROM customer")
def api_map_replies(spark: SparkSession, d: str) -> DataFrame:
    reply = '{"item_path":"data.posts","field_mapping":{"link":"url","title":"","x":null},"caveats":[1,"b"]}'
    r = P.checked_api_map(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(reply).alias("reply")), "id")
    return r.select("id", "item_path", F.col("field_mapping")["link"].alias("link"), F.size("field_mapping").alias("n_fields"), F.size("caveats").alias("n_caveats"))


@query("SELECT c_custkey AS id, '5' AS max_pages, '*/*' AS accept, 2 AS n_changes FROM customer")
def debug_diffs(spark: SparkSession, d: str) -> DataFrame:
    """A proposed change of a recipe: scalars become text, headers stay an object, all else goes."""
    reply = '{"diff":{"max_pages":5,"bad":[1],"request_headers":{"Accept":"*/*"}}}'
    r = P.checked_diff(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(reply).alias("reply")), "id")
    return r.select("id", F.col("diff")["max_pages"].alias("max_pages"), F.col("headers")["Accept"].alias("accept"), (F.size("diff") + F.when(F.size("headers") > 0, 1).otherwise(0)).alias("n_changes"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'code does not start with <?php; missing collectData(); dangerous call: eval(' END AS warnings, CASE WHEN c_custkey % 2 = 0 THEN 'curl_ present' ELSE '' END AS notes FROM customer")
def bridge_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of generated bridge code, as text."""
    good = "<?php class XBridge extends BridgeAbstract { const NAME='x'; const URI='x'; const DESCRIPTION='x'; const MAINTAINER='me'; const PARAMETERS=[]; function collectData() { curl_init(); } }"
    code = F.when(F.col("c_custkey") % 2 == 0, good).otherwise(good.replace("<?php ", "").replace("collectData", "run").replace("curl_init()", "eval('x')"))
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *P.bridge_warnings(code, F.lit("XBridge"), "me"))
    return found.select("id", F.array_join("warnings", "; ").alias("warnings"), F.array_join("notes", "; ").alias("notes"))


SUMMARY = "CASE WHEN n = 0 THEN 'none' ELSE first3 || CASE WHEN n > 3 THEN chr(10) || '...and ' || (n - 3) || ' more' ELSE '' END END"


@query(f"SELECT page_id, {SUMMARY} AS summary FROM (SELECT page_id, count(*) AS n, string_agg(id || ' score=' || score, chr(10) ORDER BY k) FILTER (k <= 3) AS first3 FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, id) AS k FROM ({KINDS})) GROUP BY 1)")
def candidate_summaries(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.col("id").cast("string"), F.lit(" score="), F.col("score").cast("string"))
    return P.summaries(_candidates(spark, d).withColumn("line", line), "page_id", [F.desc("score"), "id"])


@query("SELECT p_partkey AS id, 'Choose how to read this site.' || chr(10) || 'URL: https://x.example.com/' || p_partkey || chr(10) || 'Feeds: none' || chr(10) || 'Reply with JSON.' AS prompt FROM part")
def strategy_prompts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("https://x.example.com/"), F.col("p_partkey").cast("string")).alias("url"), F.lit("none").alias("feeds"))
    return c.select("id", P.prompt("Choose how to read this site.", {"URL": F.col("url"), "Feeds": F.col("feeds")}, "Reply with JSON.").alias("prompt"))


@query("SELECT c_custkey AS feed_id, CASE c_custkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' ELSE 'ok' END AS outcome, CASE c_custkey % 4 WHEN 0 THEN 'no config' WHEN 1 THEN 'config not found' WHEN 2 THEN repeat('e', 500) END AS error, CASE WHEN c_custkey % 4 = 3 THEN 5 END AS item_count FROM customer")
def refresh_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    feeds = table(spark, d, "customer").select(k.alias("feed_id"), F.when(k % 4 != 0, k).alias("config_id"))
    configs = feeds.where("config_id is not null and config_id % 4 <> 1").select("config_id")
    runs = configs.select("config_id", F.lit(5).alias("item_count"), F.when(F.col("config_id") % 4 == 2, F.repeat(F.lit("e"), F.lit(600))).alias("error"))
    return I.refresh_outcomes(feeds, configs, runs)


@query("SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'data.posts' ELSE 'data.posts.nodes' END AS path FROM orders")
def graphql_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """An object of one member at a reply's path is unwrapped."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), D.unwrapped(F.when(k % 2 == 0, '{"data":{"posts":[{"a":1}]}}').otherwise('{"data":{"posts":{"nodes":[{"a":1}]}}}'), F.lit("data.posts")).alias("path"))


@query("SELECT o_orderkey AS id, '{\"q\": \"x\", \"page\": \"3\"}' AS body, 'not json' AS other FROM orders")
def set_body_member(spark: SparkSession, d: str) -> DataFrame:
    one = S.set_body_param(F.lit('{"q":"x","page":1}'), F.lit("page"), F.lit("3"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), one.alias("body"), S.set_body_param(F.lit("not json"), F.lit("page"), F.lit("3")).alias("other"))
