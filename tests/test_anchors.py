"""Anchors of a page are found where it is parsed: the same rows as over the relation of nodes, and no node is shuffled, kept or broadcast."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom import api
from feedloom.operators import anchors, candidates, selectors
from feedloom.plans.queries import QUERIES
from feedloom.sources.dom import nodes

POSTS = "<ul>" + "".join(f"<li class='mt-2 post'><a href='/{k}'>A fairly long headline {k}</a> <b>{d}</b></li>" for k, d in enumerate(["January 8, 2026", "2025-12-01", "Nov 15, 2025", "3 days ago"])) + "</ul>"
#: a mark upon a letter belongs to its word, so that no date begins after it; a digit of another script is no digit of a date
ODD = [POSTS, "", "text", POSTS.replace("3 days", "Straße İ3 days").replace("2025-12-01", "İYESTERDAY"), POSTS.replace("2025-12-01", "é2025-12-01"), "<ol>" + "<li><a href='/x'>twenty characters or more</a><br>2025-12-01 tail</li>" * 3 + "</ol>", "<p>٢٠٢٥-12-01</p>" * 3, POSTS * 2]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([*enumerate(ODD)], "page_id long, html string")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, k % 4, "O", 10.0 + k, dt.datetime(2024, 1, 1), "5-LOW") for k in range(1, 60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_date_anchors_as_over_nodes(pages):
    got, want = anchors.date_anchors(pages), candidates.date_anchors(nodes(pages))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() >= 3


def test_example_anchors_as_over_nodes(spark, pages):
    examples = spark.createDataFrame([(k, f, n) for k in range(len(ODD)) for f, n in (("title", "LONG headline 1"), ("content", "2025"), ("author", None))], "page_id long, field string, needle string")
    got, want = anchors.example_anchors(pages, examples), candidates.example_anchor(nodes(pages), examples)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() >= 3


def test_fields_of_the_first_item(pages):
    got = {r["page_id"]: r for r in selectors.derived_fields(pages).collect()}
    assert (got[0]["title"], got[0]["link"], got[0]["timestamp"], got[0]["guessed_title"]) == (".//a", ".//a/@href", ".//b", "descendant::a") and 1 not in got


def test_reanchor_and_rows(spark, pages):
    needles = spark.createDataFrame([(0, "long  HEADLINE 2"), (0, " "), (1, "x"), (7, "headline 3")], "page_id long, needle string")
    assert sorted(map(tuple, selectors.reanchor(pages, needles).collect())) == [(0, 1, "//li[contains(@class,'post')]"), (7, 1, "//li[contains(@class,'post')]")]
    rows = spark.createDataFrame([(0, 4, "title", "headline 2"), (0, 4, "link", "/2"), (0, 4, "author", "absent"), (1, 0, "title", "x")], "page_id long, row int, field string, needle string")
    (got,) = selectors.row_anchors(pages, rows).collect()
    assert (got["row"], got["selector"], got["item_count"], got["n_fields"], got["confidence"], got["fields"]) == (4, "//li[contains(@class,'post')]", 4, 2, 0.52, {"title": ".//a", "link": ".//a/@href"})


ANCHORED = ["multi_row_anchor", "reanchored", "date_anchor_items", "derived_fields", "lca_anchor"]


@pytest.mark.parametrize("name", ANCHORED)
def test_no_node_is_shuffled_kept_or_broadcast(spark, sf, name):
    """Pages and what is derived from them for examples meet by the key that they were made by; nothing else is moved."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "InMemoryTableScan" not in plan and plan.count("MapInArrow") == 1
    assert plan.count("Exchange hashpartitioning") <= (5 if name == "multi_row_anchor" else 3)


def test_discover_keeps_no_text_of_nodes(spark, pages):
    """All kinds read the pages as they were written once; nodes are kept for blocks only, and none is broadcast."""
    found = api.discover(pages.withColumn("url", F.lit("https://x.example.com/")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "own_text" not in plan and "Broadcast" not in plan
    dates = {(r["page_id"], r["selector"], r["item_count"]) for r in found.where("kind = 'date_anchor'").collect()}
    assert dates == {(r["page_id"], r["selector"], r["item_count"]) for r in anchors.date_anchors(pages).collect()} and dates
    assert (0, "//li[contains(@class,'post')]") in {(r["page_id"], r["selector"]) for r in found.where("kind = 'xpath'").collect()}
