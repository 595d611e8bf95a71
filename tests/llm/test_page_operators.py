"""WARC archives and HTML extraction."""

import base64
import hashlib
import html.parser
import random
import zipfile
from collections import defaultdict

import pytest

from feedloom.llm import html_extraction, warc_archive


def collect(df):
    return [r.asDict() for r in df.collect()]


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, tmp_path, least):
    rows = [(k, f"https://h{k % 3}.example.com/{k}", f"<p>{k % 7}é</p>" if k % 5 else None) for k in range(60)]
    rows += [(100, None, ""), (101, "bad\r\nurl", "x" * 300_000), (None, "u", "<p>1é</p>"), (None, "u", "only here"), (102, "u", "dup"), (102, "u", "dup")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id long, url string, html string, key int, payload string")
    manifest = warc_archive.write_archives(df, f"{tmp_path}/a", least_bytes=least)
    got = collect(warc_archive.read_archives(manifest))
    assert len(got) == len(rows)
    last = defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None:
            p = (h or "").encode()
            last[p] = max(i, last[p] if last[p] is not None else i)
    html = {}
    for i, _, h in rows:
        html.setdefault(i, set()).add((h or "").encode())
    by_digest = {sha(p): p for ps in html.values() for p in ps}
    for g in got:
        p = by_digest[g["payload_digest"]]
        assert p in html[g["page_id"]] and g["payload_bytes"] == len(p)
        to = last[p] if len(p) >= least and last[p] != g["page_id"] else None
        assert (g["record_type"], g["refers_to"]) == (("revisit", to) if to is not None else ("response", None))
        assert g["payload"] == (None if to is not None else p)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_archive.read_archives(warc_archive.write_archives(df, f"{tmp_path}/e")).count() == 0


def test_zip64_directory_and_refusals(tmp_path, monkeypatch):
    path = tmp_path / "z.wacz"
    a = warc_archive.Archive(str(path))
    for k in range(5):
        a.add(warc_archive.record(k, "u", b"x%d" % k, sha(b"x%d" % k), None, False), f"{k}", page=k)
    a.close()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # what follows writes ZIP64 extra fields and end records
    far = tmp_path / "far.wacz"
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(far, "w", zipfile.ZIP_STORED) as out:
        for name in z.namelist():
            out.writestr(name, z.read(name))
        out.comment = b"a comment of some length"
    monkeypatch.undo()
    for p in (path, far):
        r = warc_archive.Reader(str(p))
        assert [h["page-id"] for h, _ in r.records(r.index())] == [str(k) for k in range(5)]
    with pytest.raises(ValueError):
        broken = tmp_path / "b.zip"
        broken.write_bytes(b"no archive at all" * 10)
        warc_archive.Reader(str(broken))
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr(warc_archive.INDEX, "x" * 100)
    with pytest.raises(ValueError):
        warc_archive.Reader(str(tmp_path / "c.zip")).index()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body><header><h2>Site</h2><nav><a href=/>Home</a></nav></header>
<div id="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Head {k} &amp; line</h1></header><p>One<b>two</b> three&nbsp;{k}<p>Four<br>five {k}
<ul><li>a {k}<li>b {k}</ul><blockquote>said {k} &lt;so&gt;</blockquote><p>Read our <b>magazine</b></p><aside>rel</aside><form><input value="v"><label>name</label></form><div class="advert-box">BUY</div><script>if (a < b) document.write("<p>no</p>")</script></article>
<section class="comments"><p>me too</p></section></main><div class="sidebar"><p>old</p></div><footer>f</footer></body></html>"""


def test_article_pages(spark):
    rows = [(k, f"https://a.example.com/{k}", PAGE.format(k=k)) for k in range(6)] + [(50, None, None), (51, "", ""), (52, "https://a.example.com/x", "plain text &amp; more"), (53, "x", "<p>" + "word " * 50_000 + "</p>"), (0, "https://a.example.com/0", PAGE.format(k=0))]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, tree int")
    got = {g["page_id"]: g for g in collect(html_extraction.extract(df))}
    for k in range(6):
        assert got[k]["text"] == f"Head {k} & line Onetwo three {k} Four five {k} a {k} b {k} said {k} <so>"
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[50]["text"] == "" and got[51]["text"] == "" and got[52]["text"] == "plain text & more" and got[53]["n_chars"] == 249_999
    assert html_extraction.extract(df).count() == len(rows) and html_extraction.extract(df.limit(0)).count() == 0


def test_slots_without_article_elements(spark):
    page = '<html><body><div class="top">Daily News</div><div class="links"><a href=/a>Alpha {k}</a> <a href=/b>Beta {k}</a></div><div class="text"><p>Story {k} begins.</p><p>It ends {k}.</p></div>{more}<div class="end">All rights reserved</div></body></html>'
    rows = [(k, f"https://b.example.com/{k}", page.format(k=k, more='<div class="extra">Also {}</div>'.format(k) if k == 3 else "")) for k in range(8)]
    got = {g["page_id"]: g["text"] for g in collect(html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got[1] == "Story 1 begins. It ends 1." and got[3] == "Story 3 begins. It ends 3. Also 3"


WRAPPERS = [
    ('<html class="no-cookie"><body class="has-sidebar newsletter-open"><article><p>{}</p></article>', ""),
    ('<body class="no-widget"><form action=x><div class="page-menu"><main class="has-sidebar"><article><p>{}</p></article></main></div></form>', ""),
    ('<body><form><div id="no-promo-wrap"><p>{}</p></div></form>', ""),
    ('<body><main><h1>{}</h1><article class="post has-sidebar"><p>{}</p><p>{}</p></article></main>', ""),
    ('<body><div class="sidebar"><p>{}</p></div>', ""),
    ('<body><main><p>{}</p></main>', '<div class="sidebar"><article><p>teaser</p></article></div><section class="comments"><p>me too</p></section>'),
]


def test_names_of_wrappers_lose_no_article(spark):
    story, rows, want = "Story {} goes on and on for many words.", [], {}
    for c, (start, end) in enumerate(WRAPPERS):
        for k in range(4):
            want[len(rows)] = " ".join([story.format(k)] * start.count("{}"))
            rows.append((len(rows), f"https://w{c}.example.com/{k}", start.replace("{}", story.format(k)) + end + "<footer>f</footer>"))
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def extracted(spark, pages):
    df = spark.createDataFrame([(k, f"https://d.example.com/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extraction.extract(df).orderBy("page_id").collect()]


STORY = "<p>Story {k} tells of many things, one after the other, until it ends.</p>"


CASES = [
    ('<body class="right-sidebar"><article>{}', "{}"),
    ('<body class="single comments-open"><main>{}', "{}"),
    ('<html class="no-cookie"><body><article>{}', "{}"),
    ('<body><div class="content has-sidebar">{}', "{}"),
    ('<article>{}<div class="search-results"><p>Search {k}</p></div><section class="discussion"><p>We discuss {k}.</p></section>', "{} Search {k} We discuss {k}."),
    ('<article>{}<p>Go <span class="advert">BUY NOW</span><span style="display: none">x</span> on, {k}</p>', "{} Go on, {k}"),
    ('<article>{}<pre><code><span class="comment"># note {k}</span> x</code></pre><div class="comments"><p>me too {k}</p></div>', "{} # note {k} x"),
    ('<div class="story">{}</div><article class="teaser"><p>{k}</p></article>', "{} {k}"),
    ('<article><h1><a href=/x>Head {k}</a></h1>{}<ul class="x"><li><a href=/1>One {k}</a><li><a href=/2>Two {k}</a></ul></article>', "Head {k} {}"),
    ('<article>{}<p class="related-work">Others {k}.</p><p class="market-share">Half {k}.</p><div class="notice-board-history">Once {k}.</div></article>', "{} Others {k}. Half {k}. Once {k}."),
    ('<article>{}<p>Let <math><mi>x</mi> <mo>=</mo> <mn>{k}</mn><annotation>x{k}</annotation></math> be.</p><svg><title>t</title><path d="m"/><text>label {k}</text></svg></article>', "{} Let x = {k} be. label {k}"),
    ('<article>{}<xmp>if a < b: &amp; {k}</xmp><p>so {k}</p></article>', "{} if a < b: &amp; {k} so {k}"),
    ('<article>{}<div class="comment-list"><p>me too {k}</p></div><div class="ad-slot-right">Buy {k}</div><p>end {k}</p></article>', "{} end {k}"),
    ('<div class="lead">{}{}{}</div><article>{}</article>', "{} {} {} {}"),
    ('<article>{}<div><p>Subscribe to all our many letters.</p></div></article><div>Made {k} by hand</div>', "{}"),
]


def test_slots_and_names(spark):
    story, rows, want = "Story {k} tells of many things, one after the other, until it ends.", [], {}
    for c, (page, text) in enumerate(CASES):
        for n in (1, 5):
            if n == 1 and ("<ul" in page or "Subscribe" in page):
                continue  # one page has no host statistics
            for k in range(n):
                want[len(rows)] = text.replace("{}", story).replace("{k}", str(k))
                rows.append((len(rows), f"https://c{c}-{n}.example.com/{k}", page.replace("{}", STORY).replace("{k}", str(k))))
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_copies_of_a_page_make_nothing_constant(spark):
    page = "<article><h1>Head</h1>" + STORY.replace("{k}", "0") * 3 + "</article>"
    text = " ".join(["Head"] + ["Story 0 tells of many things, one after the other, until it ends."] * 3)
    assert extracted(spark, [page] * 6) == [text] * 6
    near = [page.replace("</h1>", f" {k}</h1>") for k in range(4)]  # nearly all is constant: the pages are copies
    assert extracted(spark, near) == [text.replace("Head", f"Head {k}") for k in range(4)]


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 5_000 + "deep {} text" + "</div>" * 5_000
    other = "<div>" * 4_000 + "<p>x</p>" + "deep {} text"
    unclosed = "<article>open {} text" + "<a <b <svg <iframe " * 30_000
    got = extracted(spark, [deep.format(1), deep.format(2), other.format(3), unclosed.format(4), "<p>" * 20_000 + "end 5", '<p title="never closed>six'])
    assert got[:2] == ["deep 1 text", "deep 2 text"] and got[2] == "x deep 3 text" and got[3].startswith("open 4 text") and got[4] == "end 5"


def best_matching(one, other, a=-1, b=-1):
    """Brute force: the size of the largest top-down, order-preserving matching below a and b."""
    xs, ys = ([k for k, (p, _) in enumerate(t) if p == r] for t, r in ((one, a), (other, b)))

    def go(i, j):
        if i == len(xs) or j == len(ys):
            return 0
        best = max(go(i + 1, j), go(i, j + 1))
        if one[xs[i]][1] == other[ys[j]][1]:
            best = max(best, 1 + best_matching(one, other, xs[i], ys[j]) + go(i + 1, j + 1))
        return best

    return go(0, 0)


def test_tree_matching_against_brute_force():
    r = random.Random(8)

    def tree(n):
        return [(-1, "html")] + [(r.randrange(k), r.choice("abc")) for k in range(1, n)]

    for _ in range(300):
        one, other = tree(r.randint(1, 9)), tree(r.randint(1, 9))
        got = html_extraction.align(one, other)
        pairs = [(x, y) for x, y in enumerate(got) if y >= 0]
        assert len({y for _, y in pairs}) == len(pairs) == best_matching(one, other)
        for x, y in pairs:
            assert one[x][1] == other[y][1] and (got[one[x][0]] if one[x][0] >= 0 else -1) == other[y][0]
        siblings = {}
        for x, y in pairs:
            siblings.setdefault(one[x][0], []).append(y)
        assert all(ys == sorted(ys) for ys in siblings.values())


class Articles(html.parser.HTMLParser):
    """Blocks of text of a page whose main text is its article elements, for a comparison with the query."""

    def __init__(self, page):
        super().__init__()
        self.blocks, self.now, self.inside, self.skip = [], "", 0, 0
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        if t := " ".join(self.now.split()):
            self.blocks.append(t)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        if tag == "br":
            self.now += " "
        elif tag not in ("b", "a"):
            self.cut()

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.cut()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.now += data


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    blocks = {p.page_id: Articles(p.html or "").blocks for p in pages}
    hosts = defaultdict(set)
    for p in pages:
        hosts[p.url.split("/")[2].lower()].add(tuple(blocks[p.page_id]))
    got = {r.page_id: r for r in html_extraction.op8_html_extraction(spark, d).collect()}
    assert len(got) == len(pages)
    for p in pages:
        every = hosts[p.url.split("/")[2].lower()]
        often = {b for b in blocks[p.page_id] if sum(b in x for x in every) >= max(3, len(every) / 2)}
        want = [b for b in blocks[p.page_id] if b not in often]
        assert got[p.page_id].text in (" ".join(want), " ".join(blocks[p.page_id])) if often else got[p.page_id].text == " ".join(want)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_simple_tree_matching():
    a = [(-1, "html"), (0, "body"), (1, "nav"), (1, "div"), (3, "p"), (1, "footer")]
    b = [(-1, "html"), (0, "body"), (1, "div"), (2, "h1"), (2, "p"), (1, "footer")]
    assert html_extraction.align(a, b) == [0, 1, -1, 2, 4, 5]
    assert html_extraction.align(a, a) == [*range(6)]
