"""Relational rows rendered as the payloads that a feed extractor meets, so that plain SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import xml_escape


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items: cust, key, title, url, date."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("key"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" & "), "o_orderpriority").alias("title"), F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")).alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def _ordered(rows: DataFrame, by: str, what) -> DataFrame:
    return rows.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("key", what.alias("v")))), lambda x: x["v"]).alias("vs"))


def json_payloads(spark: SparkSession, d: str, page_size: int | None = None) -> DataFrame:
    """(cust, page_idx, body): {"meta": …, "data": {"posts": [...]}} of each customer's orders, in pages."""
    o = order_items(spark, d)
    size = page_size or 1_000_000
    o = o.withColumn("k", F.row_number().over(Window.partitionBy("cust").orderBy("key")) - 1).withColumn("page_idx", F.floor(F.col("k") / size).cast("int"))
    item = F.to_json(F.struct("title", "url", F.col("date").alias("published_at"), F.col("status").alias("tag")))
    rows = o.groupBy("cust", "page_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", item.alias("v")))), lambda x: x["v"]).alias("vs"))
    return rows.select("cust", "page_idx", F.concat(F.lit('{"meta":{"tags":[{"id":1}],"page":'), F.col("page_idx").cast("string"), F.lit('},"data":{"posts":['), F.array_join("vs", ","), F.lit("]}}")).alias("body"))


def html_lists(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, html): a page for each customer, its orders as blocks; every fifth order is a featured block of another class."""
    o = order_items(spark, d)
    featured = F.col("key") % 5 == 0
    block = F.concat(
        F.when(featured, '<article class="featured">').otherwise('<article class="post-card mt-4">'),
        F.lit('<h2 class="post-card__title"><a href="'), "url", F.lit('">'), xml_escape(F.col("title")), F.lit("</a></h2>"),
        F.lit('<time datetime="'), "date", F.lit('">'), "date", F.lit("</time>"), F.lit('<p class="summary">Priced at '), F.col("price").cast("string"), F.lit(" in all, thank you<br>for the order</p></article>"),
    )
    rows = _ordered(o, "cust", block)
    head = F.concat(F.lit('<!DOCTYPE html><html><head><title>Customer '), F.col("cust").cast("string"), F.lit('</title><script>var t="<p>";</script></head><body><nav><ul><li class="menu-item"><a href="/">a</a><li class="menu-item"><a href="/b">b</a><li class="menu-item"><a href="/c">c</a></ul></nav><main class="post-list">'))
    return rows.select(F.col("cust").alias("page_id"), F.concat(head, F.array_join("vs", ""), F.lit('</main><aside class="sidebar"><p>old news</p></aside><footer>f</footer></body></html>')).alias("html"))


def embedded_pages(spark: SparkSession, d: str) -> DataFrame:
    """(cust, html): the payload in a script; for even customers as a data script, for odd ones as an assignment with traps."""
    p = json_payloads(spark, d)
    trap = F.concat(F.lit("<script>/* { */ window.__DATA__ = "), F.concat(F.lit('{"note":"… } … {",'), F.substring("body", 2, 100_000_000)), F.lit("; // }\n</script>"))
    data = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), "body", F.lit("</script>"))
    return p.select("cust", F.concat(F.lit("<html><body><script>track();</script>"), F.when(F.col("cust") % 2 == 0, data).otherwise(trap), F.lit("</body></html>")).alias("html"))


def feeds_xml(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(cust, body): each customer's orders as an Atom or RSS document."""
    o = order_items(spark, d)
    if kind == "atom":
        entry = F.concat(F.lit("<entry><title>"), xml_escape(F.col("title")), F.lit('</title><link href="'), "url", F.lit('"/><updated>'), "date", F.lit("T00:00:00Z</updated><summary>"), "status", F.lit("</summary></entry>"))
        head, tail = '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>', "</feed>"
    else:
        entry = F.concat(F.lit("<item><title>"), xml_escape(F.col("title")), F.lit("</title><link>"), "url", F.lit("</link><pubDate>"), "date", F.lit("</pubDate><description>"), "status", F.lit("</description></item>"))
        head, tail = '<rss version="2.0"><channel><title>t</title>', "</channel></rss>"
    return _ordered(o, "cust", entry).select("cust", F.concat(F.lit(head), F.array_join("vs", ""), F.lit(tail)).alias("body"))


def captures(spark: SparkSession, d: str) -> DataFrame:
    """(cust, ord, method, url, status, content_type, body, request_body): two GraphQL exchanges and one image for each customer."""
    p = json_payloads(spark, d)
    op = lambda k, q: F.struct(F.lit(k).alias("ord"), F.lit("POST").alias("method"), F.lit("https://shop.example.com/graphql").alias("url"), F.lit(200).alias("status"), F.lit("application/json").alias("content_type"), F.col("body"), F.concat(F.lit('{"query":"query Posts { posts { title } }","variables":{"page":'), F.lit(k).cast("string"), F.lit(',"size":10}}')).alias("request_body"))
    image = F.struct(F.lit(2).alias("ord"), F.lit("GET").alias("method"), F.lit("https://cdn.example.com/x.png?v=1").alias("url"), F.lit(200).alias("status"), F.lit("image/png").alias("content_type"), F.lit("").alias("body"), F.lit(None).cast("string").alias("request_body"))
    return p.select("cust", F.explode(F.array(op(0, ""), op(1, ""), image)).alias("c")).select("cust", "c.*")


def hars(spark: SparkSession, d: str) -> DataFrame:
    """(cust, har): for each customer a HAR of one search a status of orders (a flat array, so that it scores) and a pixel."""
    o = order_items(spark, d)
    item = F.to_json(F.struct("title", "url", F.col("date").alias("published_at")))
    g = o.groupBy("cust", "status").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", item.alias("v")))), lambda x: x["v"]).alias("vs"))
    body = F.concat(F.lit("["), F.array_join("vs", ","), F.lit("]"))
    entry = F.to_json(F.struct(
        F.struct(F.lit("get").alias("method"), F.concat(F.lit("https://api.example.com/search?status="), "status").alias("url"), F.array(F.struct(F.lit("Accept").alias("name"), F.lit("*/*").alias("value")), F.struct(F.lit("Cookie").alias("name"), F.lit("s=1").alias("value"))).alias("headers")).alias("request"),
        F.struct(F.lit(200).alias("status"), F.struct(F.lit("application/json; charset=utf-8").alias("mimeType"), body.alias("text")).alias("content")).alias("response"),
    ))
    pixel = '{"request":{"method":"GET","url":"https://a.example.com/p.png","headers":[]},"response":{"status":200,"content":{"mimeType":"image/png","text":""}}}'
    rows = g.groupBy("cust").agg(F.sort_array(F.collect_list(F.struct("status", entry.alias("e")))).alias("es"))
    return rows.select("cust", F.concat(F.lit('{"log":{"version":"1.2","entries":['), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit(f",{pixel}]}}}}")).alias("har"))


def refresh_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a refresh log: feed_id, ts, event_id, ok, item_count."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("feed_id"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type").isin("purchase", "signup"), F.lit(1)).otherwise(0).alias("item_count"))
