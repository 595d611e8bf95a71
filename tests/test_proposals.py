"""Proposed selectors on small pages: one for each way to end, and many for one page."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import proposals
from feedloom.operators.xpath import _ok, compile_path, find
from feedloom.sources.dom import Tree

PAGE = "<body><ul><li class='m'><a href='/'>home</a></li></ul><main>" + "".join(f"<div class='row'><h3><a href='/{i}'>Story {i}</a></h3><p>by {i % 2}</p></div>" for i in range(25)) + "</main></body>"
ROWS = '"item_selector": "//div[@class=\'row\']"'
REPLIES = [  # page, proposal, kind, reply, reason
    (1, "better", "improve", "{" + ROWS + ', "title_selector": ".//h3", "link_selector": ".//a/@href", "content_selector": ".//p"}', None),
    (1, "equal", "improve", "{" + ROWS + ', "title_selector": ".//h3", "link_selector": ".//a/@href", "content_selector": ".//p", "author_selector": "  "}', None),
    (1, "same", "improve", "{}", "no better"),
    (1, "menu", "hunt", '{"item_selector": "//li", "title_selector": ".//a"}', "examples lost"),
    (1, "wrapper", "hunt", '{"item_selector": "//main", "title_selector": ".//h3"}', "examples lost"),
    (5, "wrapper", "hunt", '{"item_selector": "//main", "title_selector": ".//h3"}', "no better"),
    (1, "prose", "hunt", "There is no list.", "reply is not a JSON object"),
    (1, "list", "hunt", "[1, 2]", "reply is not a JSON object"),
    (1, "null", "hunt", None, "reply is not a JSON object"),
    (1, "empty", "hunt", '{"item_selector": null, "title_selector": ".//h3"}', "no item selector"),
    (1, "bad", "improve", '{"item_selector": "//div[position()<3]"}', "invalid item selector"),
    (1, "nothing", "improve", '{"item_selector": "//table"}', "no hits"),
    (1, "bare", "hunt", "{" + ROWS + "}", "no field filled"),
    (2, "first", "hunt", "{" + ROWS + ', "title_selector": ".//h3"}', None),  # a page without a recipe
    (2, "unnamed", "refine", '{"title_selector": ".//h3"}', "no item selector"),
    (3, "lost", "hunt", "{" + ROWS + "}", "no page"),
    (4, "blank", "hunt", "{" + ROWS + "}", "no page"),  # null html
    (5, "fields", "refine", '{"item_selector": "//nowhere", "content_selector": ".//p", "title_selector": ".//h3[1]"}', None),
    (None, "no id", "hunt", "{}", ""), (1, None, "hunt", "{}", ""),
]


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, PAGE), (4, None), (5, PAGE)], "page_id long, html string")
    present = spark.createDataFrame([(k, "//div[@class='row']", {"title": ".//h3", "link": ".//b/@href"}) for k in (1, 3, 5, 6)], "page_id long, item string, fields map<string,string>")
    replies = spark.createDataFrame([r[:4] for r in REPLIES], "page_id long, proposal string, kind string, reply string")
    examples = spark.createDataFrame([(1, "title", " STORY  3 "), (5, "title", "no such story")], "page_id long, field string, needle string")
    return pages, present, replies, examples


def test_verdicts(tables):
    pages, present, replies, examples = tables
    got = {(r["page_id"], r["proposal"]): r for r in proposals.judged(pages, present, replies.unionByName(replies), examples).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {(p, n): why for p, n, _, _, why in REPLIES if why != ""}
    assert sorted(k for k, r in got.items() if r["chosen"]) == [(1, "better"), (2, "first"), (5, "fields")]  # of equals the smaller name
    better, fields = got[1, "better"], got[5, "fields"]
    assert (better["hits"], better["n_filled"], better["n_distinct"], better["n_examples"], better["confidence"]) == (25, 60, 20, 1, 0.7)
    assert fields["ignored"] == ["title"] and fields["fields"] == {"title": ".//h3", "link": ".//b/@href", "content": ".//p"} and fields["item"] == "//div[@class='row']"
    assert got[5, "wrapper"]["confidence"] == 0.3


def test_adopted_recipes(tables):
    pages, present, replies, examples = tables
    got = {r["page_id"]: r for r in proposals.adopted(proposals.judged(pages, present, replies, examples), present).collect()}
    assert {k: r["proposal"] for k, r in got.items()} == {1: "better", 2: "first", 3: None, 5: "fields", 6: None}
    assert got[3]["fields"] == {"title": ".//h3", "link": ".//b/@href"} and got[2]["item"] == "//div[@class='row']"


def test_many_proposals_for_one_page(spark, tables):
    """A page's proposals are dealt to blocks; each is measured, whatever block it falls in. Extra columns do not matter."""
    pages, present, _, _ = tables
    many = spark.range(300).select(F.lit(1).alias("page_id"), F.col("id").cast("string").alias("proposal"), F.lit("hunt").alias("kind"), F.format_string("{\"item_selector\": \"//div\", \"title_selector\": \".//%s\"}", F.when(F.col("id") == 277, "a").otherwise("h4")).alias("reply"), F.lit(1).alias("html"))
    got = proposals.judged(pages.withColumn("item", F.lit(0)), present.where("page_id > 1"), many)
    assert [r["proposal"] for r in got.where("chosen").collect()] == ["277"] and got.count() == 300


def test_no_rows(tables):
    pages, present, replies, _ = tables
    assert proposals.judged(pages, present, replies.limit(0)).count() == 0
    assert proposals.adopted(proposals.judged(pages.limit(0), present.limit(0), replies), present.limit(0)).count() == 0


def plain_find(tree, path, start):
    """Every node tested against every context."""
    out = set()
    for p in compile_path(path):
        at = {start}
        for step in p.steps:
            at = {j for k in at for j, row in enumerate(tree.rows) if (k < j and (k < 0 or j <= tree.rows[k]["last"]) if step.deep else row["parent"] == k) and _ok(row, step)}
        out |= {k for k in at if k >= 0 and (p.attr is None or p.attr in tree.rows[k]["attrs"])}
    return sorted(out)


def test_paths_by_index():
    """Index and merged contexts find what testing every node finds, on random nested pages."""
    rng = random.Random(5)
    paths = ["//div//a", "//div/div//span", "/div//div/a", ".//div", "//*[@class='x']//a", "//div//div//div", "//span | //div/a", "/*/*", "//div[@class='x']/*/@class", "."]
    for _ in range(60):
        html, opened = "", []
        for _ in range(rng.randint(0, 60)):
            if opened and rng.random() < 0.4:
                html += f"</{opened.pop()}>"
            else:
                opened.append(rng.choice(["div", "div", "span", "a"]))
                html += f"<{opened[-1]} class='{rng.choice('xy')}'>t"
        tree = Tree(html)
        for path in paths:
            for start in {-1, *(rng.sample(range(len(tree.rows)), min(3, len(tree.rows))))}:
                assert [k for k, _ in find(tree, path, start)] == plain_find(tree, path, start), (html, path, start)
