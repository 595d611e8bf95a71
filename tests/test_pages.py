"""The node relation, XPath, candidates, anchors and pruning on small pages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.operators import candidates, prune, xpath
from feedloom.sources import documents
from feedloom.sources.dom import Tree, nodes

LIST = '<div class="post-list">' + "".join(f'<article class="post"><h2 class="title"><a href="/post/{k}">Post number {k}</a></h2><time datetime="2024-01-0{k}">2024-01-0{k}</time><p class="summary">Text of the post {k}</p></article>' for k in (1, 2, 3)) + "</div>"


@pytest.fixture(scope="module")
def page(spark):
    return lambda *htmls: nodes(spark.createDataFrame([*enumerate(htmls)], "page_id long, html string")).cache()


def test_trees():
    tree = Tree("<ul><li>a<li>b<br>c</ul><p>x<p>y</div>z")
    t = tree.rows
    assert [(r["tag"], r["parent"]) for r in t] == [("ul", -1), ("li", 0), ("li", 0), ("br", 2), ("p", -1), ("p", -1)]
    assert "".join(t[3]["tail"]) == "c" and tree.text(0) == "abc" and tree.path(3) == [0, 2, 3] and t[0]["last"] == 3
    assert Tree(None).rows == [] and Tree("<script>a<b</script>").rows[0]["own"] == ["a<b"]


def test_bare_references_stay_text():
    """A named reference counts with its semicolon only, in text and attributes; scripts and the marks' own characters are untouched."""
    tree = Tree('<h1>a &amp b &lt;c &ampd &amp</h1><a href="/x?a=1&copy=2&amp;b=3">&\ue000amp &#38; &amp;amp</a><script>a&&lt b</script>')
    assert tree.text(0) == "a &amp b <c &ampd &amp" and tree.rows[1]["attrs"] == {"href": "/x?a=1&copy=2&b=3"}
    assert tree.text(1) == "&\ue000amp & &amp" and tree.text(2) == "a&&lt b"


@pytest.fixture(scope="module")
def raw(spark):
    return lambda *htmls: spark.createDataFrame([(k, h, f"https://x.example.com/dir/{k}") for k, h in enumerate(htmls)], "page_id long, html string, url string")


def test_scan(raw):
    got = xpath.scan(raw(LIST.replace("/post/", "post/"), "", "<p>none</p>"), "//article", {"link": ".//a/@href"}, url_col="url").orderBy("ord").collect()
    assert [g.link for g in got] == [f"https://x.example.com/dir/post/{k}" for k in (1, 2, 3)]
    with pytest.raises(ValueError):
        xpath.scan(raw(LIST), "//article[position()=1]", {})
    got = xpath.scan(raw(LIST, "", "<p>none</p>"), "//article[@class='post']", {"title": ".//h2[@class='title']/a", "link": ".//h2[@class='title']/a/@href", "author": ".//b", "own": "."}).orderBy("ord").collect()
    assert [(g.page_id, g.ord, g.title, g.link, g.author) for g in got] == [(0, k, f"Post number {k + 1}", f"/post/{k + 1}", "") for k in range(3)]
    assert got[0].own.startswith("Post number 1")


PATHS = ["//article", "//div/article[contains(@class,'post')]", "//div//a", ".//h2[@class='title' and @class]/a/@href", "(//time) | (//p[@class='summary'])", "//article/*", "//a[string-length(@href)>0]/text()", "//ul/li", "//article/article", "/div/article/h2"]


@pytest.mark.parametrize("path", PATHS)
def test_paths_against_another_evaluator(path):
    """ElementTree, where the pages are XML: the same nodes in the same order."""
    import xml.etree.ElementTree as ET

    html = "<div><ul><li>x</li><li>y<ul><li>z</li></ul></li></ul>" + LIST + '<article class="post"><h2 class="title"><a href="">q</a></h2><article>in</article></article></div>'
    root = ET.fromstring(f"<root>{html}</root>")
    order = {el: k for k, el in enumerate(root.iter())}
    plain = {"//div/article[contains(@class,'post')]": "//div/article[@class='post']", ".//h2[@class='title' and @class]/a/@href": "//h2[@class='title']/a", "//a[string-length(@href)>0]/text()": "//a[@href]"}
    want = set()
    for part in plain.get(path, path).replace("(", "").replace(")", "").split(" | "):
        want |= {order[el] - 1 for el in root.findall("." + part.strip()) if "string-length" not in path or el.get("href")}
    assert {pre for pre, _ in xpath.find(Tree(html), path)} == want


def test_bad_paths_are_errors_of_a_row(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(LIST, "//article[position()=1]"), (LIST, "//article"), (None, "//a")], "html string, p string")
    got = df.select(xpath.extract_items(F.col("html"), F.col("p"), F.lit('{"title":".//a"}'), F.lit("")).alias("x")).collect()
    assert "subset" in got[0].x.error and len(got[1].x["items"]) == 3 and got[2].x["items"] == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abc<>&\"' é", min_size=1, max_size=12), st.text("abc/?=&", max_size=8)), max_size=8))
def test_render_and_extract(rows):
    from html import escape

    html = "<ul>" + "".join(f'<li class="x"><a href="{escape(u)}">{escape(t)}</a>' for t, u in rows) + "</ul>"
    tree = Tree(html)
    found = [xpath.find(tree, ".//a", pre)[0][1] for pre, _ in xpath.find(tree, "//li[@class='x']")]
    links = [xpath.find(tree, ".//a/@href", pre)[0][1] for pre, _ in xpath.find(tree, "//li")]
    assert found == [t for t, _ in rows] and links == [u for _, u in rows]


def test_candidates(page):
    two = "<article>a</article>" * 2
    cards, news = "<article class='post-card'>x</article>" * 10, "<li class='news-item'>x</li>" * 8
    mixed = "<main>" + "<article class='featured'>a</article>" * 4 + "<article class='post'>b</article>" * 8 + "</main>"
    alike = mixed.replace("featured", "story")
    n = page(cards, news, two, mixed, LIST, alike)
    got = candidates.repeated_blocks(n).collect()
    by = {(g.page_id, g.selector): g for g in got}
    assert by[0, "//article[contains(@class,'post-card')]"].item_count == 10 and by[1, "//li[contains(@class,'news-item')]"].item_count == 8
    assert not [g for g in got if g.page_id == 2]
    # a union asks for confidences that differ by 0.15 at most: 0.38 and 0.63 do not, 0.51 and 0.63 do
    unions = [(g.page_id, g.item_count, float(g.confidence)) for g in got if g.is_union]
    assert unions == [(5, 12, 0.58)], unions
    assert {g.item_count for g in got if g.page_id == 3} == {4, 8}
    merged = candidates.merge(candidates.repeated_blocks(n), candidates.parser_candidates(n)).collect()
    for p in range(5):
        own = sorted((g for g in merged if g.page_id == p), key=lambda g: g.rank)
        assert len(own) <= 5 and [g.confidence for g in own] == sorted((g.confidence for g in own), reverse=True)


def test_date_anchor(page):
    dates = ["January 8, 2026", "2025-12-01", "Nov 15, 2025", "3 days ago"]
    posts = "<ul>" + "".join(f"<li class='post'><a href='/{k}'>A fairly long headline {k}</a> <span>{d}</span></li>" for k, d in enumerate(dates)) + "</ul>"
    years = "<ul>" + "".join(f"<li class='y'><a href='/{y}'>Archive of the year {y}</a></li>" for y in range(2000, 2006)) + "</ul>"
    got = candidates.date_anchors(page(posts, years)).collect()
    assert [(g.page_id, g.selector, g.item_count) for g in got] == [(0, "//li[contains(@class,'post')]", 4)]


def test_example_anchor(spark, page):
    ex = spark.createDataFrame([(0, "title", "post number 2"), (0, "content", "Text of the post 2"), (1, "title", "absent")], "page_id long, field string, needle string")
    got = candidates.example_anchor(page(LIST, "<p>x</p>"), ex).collect()
    assert [(g.page_id, g.selector, g.item_count, g.n_fields) for g in got] == [(0, "//article[contains(@class,'post')]", 3, 2)]


def test_pruning_is_idempotent_and_keeps_listing_metadata(page):
    html = "<div class='article-meta'><h3>T</h3><div class='post-meta'><span class='author'>A</span></div><div class='social-share'>s</div><script>x</script><aside>y</aside><p></p><font>w</font></div><div style='display:none'>h</div><div class='comments'>c</div>"
    n = page(html)
    once = prune.kept_nodes(n)
    tags = lambda df: sorted((r.pre, r.tag) for r in df.collect())
    assert tags(once) == tags(prune.kept_nodes(once)) == [(0, "div"), (1, "h3"), (2, "div"), (3, "span"), (8, "font")]
    assert (2, "div") not in tags(prune.kept_nodes(n, prose=True)) and any(t == "aside" for _, t in tags(prune.kept_nodes(n, keep_structure=True)))
    assert "[text:5]" in prune.skeletons(page("<p>one two three four five</p>")).first().skeleton


def test_scripts():
    two = '<script>var a = {"note":"} { \\" ", b:1};</script><script>window.__DATA__ = {"n":"… } {","items":[{"title":1},{"title":2},{"title":3}]};</script><script type="application/ld+json">{"x":[1,],}</script><script>const posts=[{"t":1}] // ]\n</script>'
    got = documents.script_values(two)
    assert [g[0] for g in got] == ["window.__DATA__", "script[type=application/ld+json]", "var posts"]
    assert documents.script_values(None) == [] and documents.balanced("{ `}` /* } */ 'a\\'}' }x", 0) == "{ `}` /* } */ 'a\\'}' }" and documents.balanced("{", 0) is None


def test_no_join_broadcasts_nodes(spark):
    """Node relations and written tables count as small by their compressed sizes; joins with what is taken from them are sorted."""
    from pyspark.sql import functions as F

    from feedloom.sources.dom import shared
    from feedloom.sources.written import written

    pages = spark.createDataFrame([(k, LIST) for k in range(5)], "page_id long, html string")
    for keep in (shared, written):
        n = keep(nodes(pages, "pre", "path", "tag", "text"))
        above = n.select("page_id", "pre", F.explode("path").alias("above"))
        got = above.join(n.where("tag <> 'p'").select("page_id", F.col("pre").alias("above"), "text").distinct(), ["page_id", "above"])
        assert got.count() == got.where("text is not null").count() > 0
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
