"""Queries of proposed selectors, over replies rendered for every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import proposals
from . import render as R
from .queries import BLOCKS, TITLE_SQL, query

#: Replies for each page: every block of the page (even pages) or those of the class that it lacks least (odd ones), a place that is
#: no list of items, a path outside the subset, no selector, no JSON, nothing found, one field mended and another spoilt.
REPLIES = {
    "a": ("improve", """Sure: {"item_selector": "%s", "title_selector": ".//h2/a", "link_selector": ".//h2/a/@href", "reasoning": "blocks of page %d"} Done."""),
    "b": ("improve", """{"item_selector": "//nav//li"}"""),
    "c": ("improve", """{"item_selector": "//article[last()]", "title_selector": ".//h2"}"""),
    "d": ("hunt", """{"title_selector": ".//h2", "reasoning": "no list of page %d"}"""),
    "e": ("hunt", """I can't find a list on page %d"""),
    "f": ("hunt", """{"item_selector": "//table//tr", "title_selector": ".//td"}"""),
    "g": ("refine", """{"item_selector": "//p", "link_selector": ".//h2/a/@href", "title_selector": ".//h2[1]"}"""),
}


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """pages, their recipes (whose link finds nothing), replies, and the title of the first order as an example."""
    pages, page = R.html_lists(spark, d), F.col("page_id")
    ids = pages.select("page_id")
    present = ids.select("page_id", F.lit(BLOCKS).alias("item"), F.create_map(F.lit("title"), F.lit(".//h2/a"), F.lit("link"), F.lit(".//b/@href")).alias("fields"))
    item = F.when(page % 2 == 0, "//article").otherwise("//article[@class='featured']")
    text = {"a": [item, page], "d": [page], "e": [page]}
    of = [F.struct(F.lit(k).alias("proposal"), F.lit(kind).alias("kind"), (F.format_string(t, *text[k]) if k in text else F.lit(t)).alias("reply")) for k, (kind, t) in REPLIES.items()]
    replies = ids.select("page_id", F.explode(F.array(*of)).alias("r")).select("page_id", "r.*")
    first = R.order_items(spark, d).groupBy(F.col("cust").alias("page_id")).agg(F.min_by("title", "key").alias("needle"))
    return pages, present, replies, first.select("page_id", F.lit("title").alias("field"), "needle")


#: Items, hits and examples of recipes a and g and of the present one, by page; the example is in a page's first order.
COUNTED = """SELECT o_custkey AS page_id, count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS cards, count(*) FILTER (o_orderkey % 5 = 0) AS featured, (min(o_orderkey) % 5 = 0)::INT AS feat FROM orders GROUP BY 1"""
MEASURED = f"""SELECT page_id, cards, CASE WHEN page_id % 2 = 0 THEN n ELSE featured END AS a, CASE WHEN page_id % 2 = 0 THEN 1 ELSE feat END AS a_examples, 1 - feat AS examples FROM ({COUNTED})"""
VERDICTS = f"""SELECT page_id, proposal, hits, least(hits, 20) * 2 AS n_filled, CASE WHEN hits = 0 THEN 'no hits' WHEN ex < examples THEN 'examples lost' WHEN least(hits, 20) < least(cards, 20) THEN 'no better' END AS reason
    FROM (SELECT page_id, 'a' AS proposal, a AS hits, a_examples AS ex, examples, cards FROM ({MEASURED}) UNION ALL SELECT page_id, 'g', cards, examples, examples, cards FROM ({MEASURED}))
  UNION ALL SELECT page_id, k, h, 0, r FROM ({MEASURED}), (VALUES ('b', 3, 'no field filled'), ('c', 0, 'invalid item selector'), ('d', 0, 'no item selector'), ('e', 0, 'reply is not a JSON object'), ('f', 0, 'no hits')) AS v(k, h, r)"""
BEST = f"SELECT page_id, arg_min(proposal, (-least(hits, 20), -hits, proposal)) AS best FROM ({VERDICTS}) WHERE reason IS NULL GROUP BY 1"


@query(f"""SELECT v.page_id, proposal, hits::INT AS hits, n_filled::INT AS n_filled, CASE WHEN hits >= 2 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence, reason, coalesce(proposal = best, false) AS chosen, CASE WHEN proposal = 'g' THEN 'title' ELSE '' END AS ignored
  FROM ({VERDICTS}) v LEFT JOIN ({BEST}) b ON v.page_id = b.page_id""")
def tested_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Every proposal with its verdict: better ones, worse ones, and those that can't be tested."""
    pages, present, replies, examples = _inputs(spark, d)
    got = proposals.judged(pages, present, replies, examples)
    return got.select("page_id", "proposal", "hits", "n_filled", "confidence", "reason", "chosen", F.array_join("ignored", ",").alias("ignored"))


@query(f"""SELECT m.page_id, best AS proposal, CASE WHEN best = 'a' THEN CASE WHEN m.page_id % 2 = 0 THEN '//article' ELSE '//article[@class=''featured'']' END ELSE '//article[contains(@class,''post-card'')]' END AS item,
  CASE WHEN best IS NULL THEN './/b/@href' ELSE './/h2/a/@href' END AS link, './/h2/a' AS title FROM ({MEASURED}) m LEFT JOIN ({BEST}) b ON m.page_id = b.page_id""")
def adopted_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Every page's recipe after its proposals were tested."""
    pages, present, replies, examples = _inputs(spark, d)
    got = proposals.adopted(proposals.judged(pages, present, replies, examples), present)
    return got.select("page_id", "proposal", "item", F.col("fields")["link"].alias("link"), F.col("fields")["title"].alias("title"))
