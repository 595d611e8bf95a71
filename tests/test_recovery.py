"""Relocation by fingerprint and the chain of fallbacks, one page for each way to end."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions.scalars import match_form_of
from feedloom.operators import recovery, selectors

BLOCK = '<article class="{c}"><h3><a href="/{i}">{t} number {i}</a></h3><p class="s">text</p></article>'


def page(cls, n=4, tag="article", wrap="main", title="Story"):
    return f'<body><{wrap} class="list">' + "".join(BLOCK.format(c=cls if isinstance(cls, str) else cls[i % len(cls)], i=i, t=title).replace("article", tag) for i in range(n)) + f'</{wrap}><footer class="f"><p>end</p></footer></body>'


CASES = {  # id: item, example, page now, stage, selector
    1: ("//article[@class='post']", None, page("post"), "exact", "//article[@class='post']"),
    2: ("//article[@class='post']", None, page("item wide"), "relocated", "//article[contains(@class,'item')]"),
    3: ("//article[@class='post']", None, page(["left", "right"]), "none", None),
    4: ("//article[@class='post']", "Story number 0.", page("row", tag="div", wrap="section").replace("h3", "h5").replace("class=\"s\"", "class=\"z\""), "recovered", "//body/section[contains(@class,'list')]/div[contains(@class,'row')]/h5/a"),
    5: ("//article[@class='post']", "Story number 0.", "<body><em>Story number 0</em></body>", "none", None),  # one hit is below the gate of three
    6: ("//footer[@class='f']", "STORY  number 1", page("post"), "recovered", "//body/main[contains(@class,'list')]/article[contains(@class,'post')]/h3/a"),  # a poor match
    7: ("//footer[@class='f']", "not on this page", page("post"), "exact", "//footer[@class='f']"),
    8: ("//a[last()]", None, page("post"), "none", None),  # outside the subset
    9: ("//article[@class='post']", None, None, "none", None),
}


@pytest.fixture(scope="module")
def tables(spark):
    recipes = spark.createDataFrame([(k, v[0], v[1]) for k, v in CASES.items()], "page_id long, item string, example string")
    recipes = recipes.withColumn("fields", F.create_map(F.lit("title"), F.lit(".//h3"), F.lit("content"), F.lit(".//b")))
    before = spark.createDataFrame([(k, page("post")) for k in CASES], "page_id long, html string")
    now = spark.createDataFrame([(k, v[2]) for k, v in CASES.items()], "page_id long, html string")
    return recipes, before, now


def test_stages(tables):
    recipes, before, now = tables
    got = {r["page_id"]: r for r in recovery.settled(recipes, now, recovery.fingerprints(before, recipes)).collect()}
    assert {k: (r["stage"], r["selector"]) for k, r in got.items()} == {k: v[3:] for k, v in CASES.items()}
    assert got[3]["outcome"] == "tie" and got[2]["drift"] and not got[1]["drift"]


def test_fields_and_items(spark, tables):
    recipes, before, now = tables
    recipes = recipes.where("page_id < 3")
    examples = spark.createDataFrame([(1, "content", "texts"), (1, "title", "story number 9"), (2, "content", "nothing like it")], "page_id long, field string, needle string")
    items, updated = recovery.repairing_scan(recipes, now, recovery.fingerprints(before, recipes), examples)
    fields = {r["page_id"]: r["fields"] for r in updated.collect()}
    assert fields == {1: {"title": ".//h3", "content": ".//p[contains(@class,'s')]"}, 2: {"title": ".//h3", "content": ".//b"}}
    rows = sorted((r["page_id"], r["ord"], r["title"], r["content"]) for r in items.collect())
    assert rows == [(p, i, f"Story number {i}", "text" if p == 1 else "") for p in (1, 2) for i in range(4)]


def test_empty_tables(tables):
    recipes, before, now = tables
    none = recipes.limit(0)
    assert recovery.settled(none, now, recovery.fingerprints(before, none)).count() == 0
    assert recovery.settled(recipes, now.limit(0), recovery.fingerprints(before.limit(0), recipes)).count() == 0


@pytest.mark.parametrize("least", [0.75, 0.85, 0.9])
def test_similar_pairs_against_brute_force(spark, least):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefgh ’é&") for _ in range(rnd.choice([0, 3, 12, 40, 260]))) for _ in range(40)]
    noisy = lambda t: "".join(c if rnd.random() > 0.08 else rnd.choice(["", "x", c + c]) for c in t)
    rows = [(k % 4, k, noisy(t)) for k, t in enumerate(base * 3)] + [(0, 900, None), (1, 901, "  ")]
    examples = [(p, t) for p in range(4) for t in base[p::4][:6]] + [(1, ""), (2, None), (7, "abc")]
    texts = spark.createDataFrame(rows, "page_id int, k int, text string")
    needles = spark.createDataFrame(examples, "page_id int, needle string")
    form = lambda t: match_form_of(t or "")
    ratio = lambda a, b: 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
    want = sorted((k, str(n)) for p, k, t in rows for q, n in examples if p == q and t is not None and ratio(form(t), form(n)) >= least)
    got = selectors.similar_pairs(texts, "text", needles, ["page_id"], least)
    assert sorted((r["k"], str(r["needle"])) for r in got.collect()) == want and want
    pairs = sum(p == q for p, _, _ in rows for q, _ in examples)
    assert selectors.candidate_pairs(texts, "text", needles, ["page_id"], least).count() < 0.6 * pairs  # the rest never reaches difflib


def test_texts_are_compared_once(spark):
    """What is left of a recovered selector's plan after the comparison is one UDF, that which counts hits."""
    from feedloom.operators import selectors
    from feedloom.sources.dom import nodes

    html = "<ul>" + "".join(f"<li class='x'><b>Text number {k}</b></li>" for k in range(4)) + "</ul>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    examples = spark.createDataFrame([(1, "text number 2"), (1, "TEXT number 2")], "page_id long, needle string")
    got = selectors.recovered_selectors(pages, nodes(pages, *selectors.STACK_COLUMNS), examples, least=0.999)
    assert [(r.selector, r.sibling_count) for r in got.collect()] == [("//ul/li[contains(@class,'x')]/b", 4)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
