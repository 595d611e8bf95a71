"""Scalar and JSON functions on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.functions import json_walk as J
from feedloom.functions import scalars as S


def column(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r.v for r in df.select("k", expr.alias("v")).orderBy("k").collect()]


def items(n, *keys):
    return json.dumps([{k: str(i) for k in keys} for i in range(n)])


def test_scores(spark):
    rows = [items(20, "title", "url", "date", "content", "author"), items(5, "title"), items(10, "foo", "bar", "qux"), None, "[]", "{}", '"hello"', "[1,2,3]", '{"a":[{"title":1}],"b":[{"title":1},{"url":1}]}', "not json"]
    got = column(spark, rows, J.feed_score(F.col("x")))
    assert got[0] == pytest.approx(0.97) and got[1] == pytest.approx(0.40) and got[2] == pytest.approx(0.22)
    assert got[3:8] == [0.0] * 5 and got[8] == pytest.approx(0.5) and got[9] == 0.0


def test_best_array(spark):
    rows = [json.dumps({"meta": {}, "results": {"posts": json.loads(items(10, "title", "url", "date"))}}), json.dumps({"tags": json.loads(items(2, "id")), "articles": json.loads(items(15, "title", "url", "date"))}), '{"a":[[{"title":1}]]}', "nope", None]
    got = column(spark, rows, J.best_array(F.col("x")))
    assert (got[0].path, got[0].n_items) == ("results.posts", 10) and got[0].score >= 0.4
    assert got[1].path == "articles" and [g.path for g in got[2:]] == [None] * 3


def test_dot_paths(spark):
    doc, paths = '{"a":{"b":[10,20]},"s":"x","n":null,"t":true}', ["a.b.1", "a.b[1]", "a.b.-1", "a.5", "", "s", "n", "t", "a.b.9"]
    df = spark.createDataFrame([(k, doc, p) for k, p in enumerate(paths)], "k int, x string, p string")
    got = [r.v for r in df.select("k", J.dot_get(F.col("x"), F.col("p")).alias("v")).orderBy("k").collect()]
    assert got[:4] == ["20", "20", "20", None] and json.loads(got[4]) == json.loads(doc) and got[5:] == ["x", None, "true", None]


def test_roles(spark):
    rows = [(1, k) for k in ("title", "url", "published_at", "body")] + [(2, k) for k in ("title", "headline", "url")] + [(3, "my_title"), (3, "page_link_2")]
    got = {(r.id, r.role): r.key for r in J.key_roles(spark.createDataFrame(rows, "id int, key string"), "id").collect()}
    assert got[1, "title"] == "title" and got[1, "date"] == "published_at" and got[1, "content"] == "body" and (2, "title") not in got and got[2, "url"] == "url" and got[3, "title"] == "my_title"


def test_paging():
    assert J.paging_of('{"q":1,"page":true,"pageSize":"20"}', "", None)[:6] == ("body", "page", "page", 1, 20, "pageSize")
    assert J.paging_of(None, "https://h/x?skip=40&limit=20", '{"a":{"total_pages":3}}') == ("query", "skip", "offset", 40, 20, "limit", None, None, "a.total_pages")
    assert J.paging_of("[]", "https://h/x?q=1", None) is None


def test_times(spark):
    rows = ["Mon, 01 Jan 2024 10:00:00 +0200", "Mon, 01 Jan 2024 10:00:00 GMT", "2024-01-01T10:00:00Z", "2024-01-01", "yesterday", "", None]
    got = column(spark, rows, F.date_format(S.parse_time(F.col("x")), "yyyy-MM-dd HH:mm"))
    assert got == ["2024-01-01 08:00", "2024-01-01 10:00", "2024-01-01 10:00", "2024-01-01 00:00", None, None, None]


def test_classes(spark):
    rows = ["mt-4 md:hover:flex card card__title w-full", "", None, "grid-cols-3 flex-1", "post--big news"]
    assert column(spark, rows, S.meaningful_classes(F.col("x"))) == [["card__title", "card"], [], [], [], ["post--big", "news"]]


def test_node_weights(spark):
    df = spark.createDataFrame([("article-card", "", ""), ("sidebar", "article", ""), ("c-item-terms", "", ""), ("x", "", "navigation"), ("comment", "", ""), ("comment article", "", "")], "cls string, id string, role string")
    got = df.select(S.class_id_weight(F.col("cls"), F.col("id")).alias("w"), S.is_unlikely(F.col("cls"), F.col("id"), F.col("role")).alias("u")).collect()
    assert [g.w for g in got[:2]] == [25, 0] and [g.u for g in got] == [False, False, True, True, True, False]


def test_text_matching(spark):
    df = spark.createDataFrame([("It’s  “fine” &amp; ﬁne…", "it's \"fine\" & fine..."), ("abcdef", "abcdxf"), (None, "")], "a string, b string")
    got = df.select(S.match_form(F.col("a")).alias("m"), S.similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert got[0].m == "it's \"fine\" & fine..." and got[0].r == 1.0 and 0.8 < got[1].r < 0.9 and got[2].r == 1.0


def test_urls(spark):
    df = spark.createDataFrame([("https://h/a/b?x=1&x=2&y=#f", "../c")], "u string, l string")
    r = df.select(S.set_query_param(F.col("u"), F.lit("y"), F.lit("9")).alias("s"), S.join_url(F.col("u"), F.col("l")).alias("j"), S.set_body_param(F.lit('{"a":1}'), F.lit("p"), F.lit("2")).alias("b"), S.bucket_key(F.lit("post"), F.col("u")).alias("k")).first()
    assert r.s == "https://h/a/b?x=2&y=9#f" and r.j == "https://h/c" and json.loads(r.b) == {"a": 1, "p": "2"} and r.k == "POST https://h/a/b"


def test_requests(spark):
    rows = [("https://h/graphql?x", "", None), ("https://h/q", "application/json", '{"query":"{ posts }"}'), ("https://h/q", None, '{"query":"posts"}'), ("https://h/q", None, "junk {"), ("https://h/q", "application/graphql", None)]
    df = spark.createDataFrame(rows, "u string, c string, b string")
    assert [r.g for r in df.select(S.is_graphql(F.col("u"), F.col("c"), F.col("b")).alias("g")).collect()] == [True, True, False, False, True]
    urls = ["https://h/api/x", "https://h/posts", "https://h/compost", "https://h/api/login", "https://h/api/a.js"]
    assert column(spark, urls, S.is_api_like(F.col("x"))) == [True, True, False, False, False]


def test_texts_are_parsed_once_in_small_pieces(spark):
    """A UDF gets few rows at a time, and the score's filter parses no text again."""
    import pandas as pd

    from feedloom.functions.udf import PIECE, arrow_udf
    from feedloom.sources import documents as D

    @arrow_udf("int")
    def rows(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x), dtype="int32")

    @arrow_udf("int")
    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return (x + y).astype("int32") + 0 * len(x)

    got = spark.range(0, 1_000, 1, 1).select("id", rows(F.col("id")).alias("n"), both(F.col("id"), F.col("id")).alias("s")).collect()
    assert [(g.id, g.s) for g in got] == [(k, 2 * k) for k in range(1_000)] and {g.n for g in got} == {PIECE}
    body = '{"data":{"posts":[{"title":"a","url":"/a"},{"title":"b","url":"/b"}]}}'
    replies = spark.createDataFrame([("s", "f", body), ("t", "f", None), ("u", "f", "{")], "site string, field string, body string")
    kept = D.replayed_queries(replies.select("site", "field"), "site", replies)
    assert [(r.site, r.path, r.n_items) for r in kept.collect()] == [("s", "data.posts", 2)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
