"""No item, candidate or example of a page is left out, however many there are."""

import datetime as dt

from feedloom import api
from feedloom.operators import selectors
from feedloom.plans import more


def test_scrape_reads_all_items(spark):
    """More items than any limit that a single read of a page or feed has."""
    k = range(120)
    feed = lambda kind, tag: f"<{kind}>" + "".join(f"<{tag}><title>t{i}</title></{tag}>" for i in k) + f"</{kind}>"
    bodies = {
        "atom": ("rss", "", '<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(f"<entry><title>t{i}</title></entry>" for i in k) + "</feed>"),
        "rss": ("rss", "", f'<rss version="2.0">{feed("channel", "item")}</rss>'),
        "json": ("json_api", "data", '{"data":[' + ",".join(f'{{"title":"t{i}"}}' for i in range(5_010)) + "]}"),
        "page": ("xpath", "//li", "<ul>" + "".join(f"<li>t{i}</li>" for i in k) + "</ul>"),
    }
    configs = spark.createDataFrame([(i, u, s, item, {"title": "title" if u != "page" else "."}, None) for i, (u, (s, item, _)) in enumerate(bodies.items())] + [(9, "json", "json_api", "data", {"title": "title"}, 7)], "config_id long, url string, strategy string, item string, fields map<string,string>, max_items int")
    responses = spark.createDataFrame([(u, 200, b) for u, (_, _, b) in bodies.items()], "url string, status int, body string")
    found, runs = api.scrape(configs, responses)
    want = {0: 120, 1: 120, 2: 5_010, 3: 120, 9: 7}
    assert {r["config_id"]: r["item_count"] for r in runs.collect()} == want
    assert {(r["config_id"], r["ord"]) for r in found.collect()} == {(c, i) for c, n in want.items() for i in range(n)}


def test_recovered_fields_try_all_candidates_and_items(spark):
    """Nine elements hold the example and 25 items the last one's path: no candidate and no item is left out."""
    first = "<article>" + "".join(f"<p class='c{k}'>same text</p>" for k in range(9)) + "</article>"
    html = "<main>" + first + "".join(f"<article><p class='c8'>text {k}</p></article>" for k in range(24)) + "</main>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    items = spark.createDataFrame([(1, "//article", 1, 10)], "page_id long, item string, pre int, last int")
    examples = spark.createDataFrame([(1, "title", "same text")], "page_id long, field string, needle string")
    got = selectors.recovered_fields(pages, items, examples, least=0.999).collect()
    assert [(r["path"], r["hits"]) for r in got] == [(".//p[contains(@class,'c8')]", 25)]


def test_example_rows_hold_their_links(spark, tmp_path):
    orders = [(k, 1, "O", 10.0 + k, dt.datetime(2024, 1, 1), "5-LOW") for k in (1, 2, 5, 10, 11)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    (got,) = more.multi_row_anchor(spark, str(tmp_path)).collect()
    # three fields, and three or two blocks: (0.3 + 0.09 + 0.2 + 0.3 + 0.06 + 0.1) / 2, rounded
    assert got["item_count"] == 5 and got["n_families"] == 2 and got["confidence"] == 0.53
