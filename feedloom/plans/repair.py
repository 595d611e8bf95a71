"""Queries of scans that repair themselves, over pages whose markup is changed by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import xml_escape
from ..operators import recovery, selectors
from . import render as R
from .queries import TITLE_SQL, query

#: Page 5k keeps its markup, 5k+1 renames the class of its blocks, 5k+2 and 5k+3 get another structure (with and without an
#: example to recover from), and 5k+4 deals its blocks to two new classes, so that neither is the likelier.
CHANGED = {"tag": ["article", "article", "div", "div", "article"], "cls": ["entry", "story lead", "row", "row", "left"], "head": ["h3", "h3", "h4", "h4", "h3"], "main": ["main", "main", "section", "section", "main"]}


def _of(kind: str, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CHANGED[kind])), (k % 5 + 1).cast("int"))


def _page(o: DataFrame, k: Column) -> DataFrame:
    """(page_id, html) of order items, in the markup that column k asks for."""
    alone = k % 5 == 4
    cls = F.when(alone & (F.col("key") % 2 == 0), "right").otherwise(_of("cls", k))
    tag, head = _of("tag", k), _of("head", k)
    block = F.concat(F.lit("<"), tag, F.lit(' class="'), cls, F.lit('"><'), head, F.lit(' class="t"><a href="'), "url", F.lit('">'), xml_escape(F.col("title")), F.lit("</a></"), head, F.lit('><p class="s">Status '), "status", F.lit("</p></"), tag, F.lit(">"))
    rows = R._ordered(o, "cust", block)
    main = _of("main", k)
    body = F.concat(F.lit("<"), main, F.lit(' class="'), F.when(k % 5 < 2, "list").when(k % 5 == 4, "list").otherwise("feed"), F.lit('">'), F.array_join("vs", ""), F.lit("</"), main, F.lit(">"))
    return rows.select(F.col("cust").alias("page_id"), F.concat(F.lit('<html><body><nav><ul><li class="menu"><a href="/">a</a></li></ul></nav>'), body, F.lit('<footer class="foot"><p>end</p></footer></body></html>')).alias("html"))


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """recipes, the pages that they were made for, the pages now, and examples of fields (a letter off)."""
    o = R.order_items(spark, d)
    k = F.col("cust")
    first = o.groupBy(k.alias("page_id")).agg(F.min_by(F.struct("title", "status"), "key").alias("f"))
    example = F.when(F.col("page_id") % 5 != 3, F.concat("f.title", F.lit("!")))
    fields = F.create_map(F.lit("title"), F.lit(".//h3[@class='t']"), F.lit("link"), F.lit(".//a/@href"))
    recipes = first.select("page_id", F.lit("//article[@class='entry']").alias("item"), F.when(F.col("page_id") % 5 == 2, example).alias("example"), fields.alias("fields"))
    examples = first.where("page_id % 5 in (0, 1)").select("page_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.concat("f.title", F.lit("?")).alias("needle")), F.struct(F.lit("content").alias("field"), F.concat(F.lit("tatus "), "f.status").alias("needle")))).alias("e")).select("page_id", "e.*")
    return recipes, _page(o, F.lit(0)), _page(o, k), examples


COUNTS = f"SELECT o_custkey AS page_id, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS evens, arg_min({TITLE_SQL}, o_orderkey) AS title, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1"
STAGE = "CASE WHEN page_id % 5 = 0 THEN 'exact' WHEN page_id % 5 = 1 OR (page_id % 5 = 4 AND evens IN (0, n)) THEN 'relocated' WHEN page_id % 5 = 2 AND n >= 3 THEN 'recovered' ELSE 'none' END"
SELECTOR = """CASE WHEN page_id % 5 = 0 THEN '//article[@class=''entry'']' WHEN page_id % 5 = 1 THEN '//article[contains(@class,''story'')]'
  WHEN page_id % 5 = 4 AND evens = 0 THEN '//article[contains(@class,''left'')]' WHEN page_id % 5 = 4 AND evens = n THEN '//article[contains(@class,''right'')]'
  WHEN page_id % 5 = 2 AND n >= 3 THEN '//html/body/section[contains(@class,''feed'')]/div[contains(@class,''row'')]/h4[contains(@class,''t'')]/a' END"""


@query(f"SELECT page_id, {STAGE} AS stage, {STAGE} IN ('relocated', 'recovered') AS drift, {SELECTOR} AS selector, page_id % 5 = 4 AND evens NOT IN (0, n) AS tied FROM ({COUNTS})")
def recovery_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every recipe's page by the stage that settles it: exact, relocated by fingerprint, recovered from an example at 0.9, or none; ties move nothing."""
    recipes, before, now, _ = _inputs(spark, d)
    got = recovery.settled(recipes, now, recovery.fingerprints(before, recipes))
    return got.select("page_id", "stage", "drift", "selector", F.coalesce(F.col("outcome") == "tie", F.lit(False)).alias("tied"))


@query(f"""SELECT page_id, CASE WHEN page_id % 5 = 2 THEN '' ELSE title END AS first_title, CASE WHEN page_id % 5 IN (0, 1) THEN 'Status ' || status ELSE '' END AS first_content, least(n, 100) AS item_count,
  CASE WHEN page_id % 5 IN (0, 1) THEN './/p[contains(@class,''s'')]' END AS content_path FROM ({COUNTS}) WHERE {STAGE} <> 'none'""")
def repaired_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of settled recipes, with fields repaired from examples at 0.85; recovered selectors hit titles, which hold none."""
    recipes, before, now, examples = _inputs(spark, d)
    items, updated = recovery.repairing_scan(recipes, now, recovery.fingerprints(before, recipes), examples)
    got = items.groupBy("page_id").agg(F.min_by("title", "ord").alias("first_title"), F.min_by("content", "ord").alias("first_content"), F.count("*").alias("item_count"))
    return got.join(updated.select("page_id", F.col("fields")["content"].alias("content_path")), "page_id")


@query("""SELECT o_custkey AS page_id, count(*) AS n_texts, count(*) FILTER (length(o_orderkey::VARCHAR) = (SELECT length(min(i.o_orderkey)::VARCHAR) FROM orders i WHERE i.o_custkey = o.o_custkey)) AS n_like
  FROM orders o GROUP BY o_custkey""")
def similar_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts like that of a page's first order at 0.9: 40 letters by the length of the order's number, and its last digit."""
    o = R.order_items(spark, d)
    text = lambda key: F.concat(F.repeat(F.element_at(F.array(*map(F.lit, "abcdefghijkl")), F.length(key.cast("string"))), F.lit(40)), F.substring(key.cast("string"), -1, 1))
    rows = o.select(F.col("cust").alias("page_id"), text(F.col("key")).alias("text"))
    examples = o.groupBy(F.col("cust").alias("page_id")).agg(F.min("key").alias("key")).select("page_id", text(F.col("key")).alias("needle"))
    like = selectors.similar_pairs(rows, "text", examples, ["page_id"], 0.9).groupBy("page_id").agg(F.count("*").alias("n_like"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_texts")).join(like, "page_id")
