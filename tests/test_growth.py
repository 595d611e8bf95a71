"""What large inputs need: pages parsed once and in part, one state value for a key, joins by sorting."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom import api
from feedloom.functions import scalars
from feedloom.operators import selectors
from feedloom.plans import machines as plans
from feedloom.sources import documents
from feedloom.sources.dom import Tree, nodes
from feedloom.streaming import machines

CARDS = '<main>' + "".join(f'<article class="card"><h2>Title {k}</h2><p class="note">Note &amp; text {k}</p></article>' for k in (1, 2, 3)) + "</main>"
PLAIN = [CARDS, "", "text", "a &lt b <P>c<p>d", "<!DOCTYPE html><title>t &amp; u</title><script>var a='<p>';</script><br/>z", "<ul><LI id='x\"' hidden>a<li>b<!-- c --></ul></b>d"]
OTHER = ["a < b", "<a b=c d>x", "<script>x", "<!-- a--b --><p>c", "<title>a<b>c</b></title>", "<p\x0bq>x", '<a b="c"d="e">f', "<script src='a'/>b", "x</", "<noscript><p>a</noscript>"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("html", PLAIN + OTHER)
def test_plain_markup_as_the_standard_parser_reads_it(html, monkeypatch):
    """Plain pages never reach the standard parser, others always do; both give the same rows."""
    fed, feed = [], Tree.feed
    monkeypatch.setattr(Tree, "feed", lambda self, text: (fed.append(text), feed(self, text)))
    shown = lambda t: ([{k: [*v] if k in ("own", "tail") else v for k, v in r.items()} for r in t.rows], t.pieces)
    got = shown(Tree(html))
    assert bool(fed) == (html in OTHER)
    monkeypatch.setattr(Tree, "plain", lambda self, text: False)
    assert got == shown(Tree(html))


def test_only_nodes_in_use_leave_the_parser(spark):
    pages = spark.createDataFrame([(1, CARDS, (1, 3))], "page_id long, html string, of struct<pre:int,last:int>")
    assert [r["pre"] for r in nodes(pages, "pre", tags=["article"]).collect()] == [1, 4, 7]
    assert [r["pre"] for r in nodes(pages, "pre", classed=True).collect()] == [1, 3, 4, 6, 7, 9]
    assert [(r["pre"], r["of"]["last"]) for r in nodes(pages, "pre", carry="of", within=True).collect()] == [(2, 3), (3, 3)]


def test_similarity_from(spark):
    texts = ["Order 12 & 5-LOW", "ORDRE  12 & 5-LOW", "no such thing", "", None, "order 12 &amp; 5-low"]
    df = spark.createDataFrame([(a, b) for b in texts for a in texts], "a string, b string")
    got = df.select(scalars.similarity("a", "b").alias("all"), scalars.similarity_from("a", "b", F.lit(0.75)).alias("some")).collect()
    assert all(r["some"] == (r["all"] if r["all"] >= 0.75 else None) for r in got) and {r["some"] is None for r in got} == {True, False}


def test_already_good_compares_nothing_that_is_held(spark, monkeypatch):
    items = spark.createDataFrame([(1, 0, "t", "Some Title"), (1, 1, "t", ""), (2, 0, "t", "Smoe Title"), (3, 0, "t", "other")], "page_id long, ord int, field string, value string")
    examples = spark.createDataFrame([(k, "t", "some title") for k in (1, 2, 3, 4)], "page_id long, field string, needle string")
    compared = []
    monkeypatch.setattr(selectors, "similarity_from", lambda one, other, least: compared.append(one) or scalars.similarity_from(one, other, least))
    got = {r["page_id"]: r["good"] for r in selectors.already_good(items, examples, "page_id").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    held = items.where("page_id = 1 and ord = 0").select("value", F.lit("some title").alias("needle"))
    assert held.select(compared[0].alias("one")).first()["one"] == ""


def test_recovered_fields_shuffle_no_page_of_nodes(spark):
    pages = spark.createDataFrame([(1, CARDS)], "page_id long, html string")
    items = spark.createDataFrame([(1, "//article", 1, 3)], "page_id long, item string, pre int, last int")
    examples = spark.createDataFrame([(1, "title", "Title 1"), (1, "content", "note & TEXT 1"), (1, "author", "Title 2")], "page_id long, field string, needle string")
    got = selectors.recovered_fields(pages, items, examples, least=0.999).collect()
    assert sorted((r["field"], r["rank"], r["path"], r["hits"]) for r in got) == [("content", 1, ".//p[contains(@class,'note')]", 3), ("title", 1, ".//h2", 3)]


def test_own_scripts_join_by_sorting(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/d/x", "<script src='1.js'></script><script src='/2.js'></script><script src='https://b.example.com/3.js'></script>")], "page_id long, url string, html string")
    got = spark.createDataFrame([("https://a.example.com/d/1.js", 404, "x"), ("https://a.example.com/2.js", 200, "y")], "url string, status int, body string")
    found = documents.own_scripts(pages, "page_id", "url", responses=got)
    assert "Broadcast" not in plan(found) and [(r["pos"], r["js"]) for r in found.collect()] == [(1, "y")]


def test_scrape_joins_responses_once(spark):
    configs = spark.createDataFrame([(1, "u", "xpath", "//article", {"title": ".//h2"}, 9), (2, "v", "json_api", "", {"title": "title"}, 9)], "config_id long, url string, strategy string, item string, fields map<string,string>, max_items int")
    responses = spark.createDataFrame([("u", 200, CARDS), ("v", 404, "[]")], "url string, status int, body string")
    found, runs = api.scrape(configs, responses)
    assert "SortMergeJoin [url" not in plan(found)
    assert [r["title"] for r in found.orderBy("ord").collect()] == ["Title 1", "Title 2", "Title 3"]
    assert {r["config_id"]: (r["item_count"], r["error"]) for r in runs.collect()} == {1: (3, None), 2: (0, "HTTP 404")}


class Value:
    def __init__(self, value=None):
        self.value, self.calls = value, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Handle:
    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("kind", ["feed", "trace"])
def test_a_key_reads_and_writes_one_state(kind):
    """Rows of a micro-batch come as rows; ids beyond 2^53 stay exact beside a null one."""
    big = 2**53 + 1
    made = lambda **x: machines.Row(**x)
    handle = Handle()
    if kind == "feed":
        machine = machines.FeedMachine(300, 3)
        rows = [made(us=k, event_id=e, kind="refresh", config_id="c", ok=True, item_count=None, error=None, llm_suggested=True, cadence="1h") for k, e in ((2, None), (1, big))]
    else:
        machine = machines.TraceMachine(7_200, 1)
        rows = [made(us=k, event_id=e) for k, e in ((2 * 10**10, None), (1, big))]
    machine.init(handle)
    out = [*machine.handleInputRows((1,), iter(rows), None)]
    (state,) = handle.values.values()
    assert state.calls == 2 and len(handle.timers) == 1
    assert big in [r["event_id"] if kind == "feed" else r["oldest_kept"] for r in out]


@pytest.mark.parametrize("rows_a_file", [10, 10**6])
def test_micro_batches_of_several_files(spark, tmp_path, monkeypatch, rows_a_file):
    monkeypatch.setattr(plans, "FILE_ROWS", rows_a_file, raising=False)
    rows = pd.DataFrame({"user_id": [k % 7 for k in range(400)], "event_id": range(400), "ts": [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * k) for k in range(400)]})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/events.parquet")
    want = plans.trace_evictions(spark, str(tmp_path)).collect()
    seen, run = [], machines.run_to_table
    monkeypatch.setattr(machines, "run_to_table", lambda spark, stream, folder: seen.append(len(spark.read.parquet(f"{folder}/in").inputFiles())) or run(spark, stream, folder))
    assert sorted(map(str, plans.trace_evictions_stream(spark, str(tmp_path)).collect())) == sorted(map(str, want))
    assert seen == [6 if rows_a_file > 100 else 60]
