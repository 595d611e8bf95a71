"""Main-text extraction by wrapper induction.

The DOM trees of same-host pages are aligned by simple tree matching against the host's most frequent tree. Aligned
slots gather statistics over all pages of the host: what stays constant, or is mostly links, is template; what varies is
content. Names of elements settle what statistics can't see (an advert that differs on every page).
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, materialise, parts, salted_join, table

#: Fixed values of HTML: elements without content, with raw text, and those that begin a block of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes iframe noscript template desc metadata annotation annotation-xml".split())
#: Elements of pictures and formulas, which may close themselves; their text is text.
FOREIGN = frozenset(["svg", "math"])
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split()
)
#: Elements whose start closes an open element of the given names (up to the nearest of the bounds).
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
#: Elements that hold no article text.
BOILER_TAGS = frozenset("nav aside footer form button select dialog menu head fieldset search".split())
#: Class, id and role names, as whole names or of parts that are all of these and of PARTS (comment-list, but not
#: related-work). The first group marks adverts and comments wherever they stand, the second menus, sidebars, notices and forms
#: outside of articles; the third may also name parts of an article. Within one, the last two only confirm statistics.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond replies disqus".split())
STRONG_WORDS = ADVERT_WORDS | frozenset(
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription "
    "paywall sidebar nav navbar navigation breadcrumb breadcrumbs pagination pager footer share sharing social related recommended recommendations contentinfo".split()
)
PARTS = frozenset("site page global main left right top bottom upper lower primary secondary list form area section box block container wrapper wrap inner outer bar banner slot unit links link posts post items item buttons button icons menu widget panel row col reply thread".split())
WEAK_WORDS = frozenset("banner notification alert signup login popup modal overlay aside rail widget widgets menu toolbar topbar masthead discussion skip toc complementary search header".split())
#: Class names that tell a state of the page (has-sidebar, comments-open) name no part of it.
STATE = re.compile(r"^(?:has|no|not|is|with|without|show|shows|hide|hides|js|can)-|-(?:open|opened|closed|enabled|disabled|active|inactive|visible|collapsed|expanded|on|off)$")
ARTICLE_TAGS = frozenset(["article", "main"])
CODE_TAGS = frozenset(["pre", "code"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^><\"']|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
DIGITS = re.compile(r"\d+")
SPACES = re.compile(r"\s+")
#: A text is constant in a slot from this many distinct pages on, if they are this share of those that fill the slot.
CONSTANT_PAGES, CONSTANT_SHARE = 3, 0.5


def digest(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """A page as a tree of labelled elements (one node for each path of labels) and its blocks of text.

    Block elements and inline elements with a class, id or role are nodes; other inline elements are part of the element
    around them.
    """

    def __init__(self, html: str | None):
        #: (parent, label); the label is tag, class, id and role, digits cut out
        self.nodes: list[tuple[int, str]] = []
        #: (node of the block, its pieces as (node, text), characters within links)
        self.blocks: list[tuple[int, list[tuple[int, str]], int]] = []
        self.places: dict[tuple[int, str], int] = {}
        self.parse(html or "")

    def node(self, parent: int, label: str) -> int:
        key = (parent, label)
        if key not in self.places:
            self.places[key] = len(self.nodes)
            self.nodes.append(key)
        return self.places[key]

    def parse(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, node (that around it for unnamed inline elements), hidden
        opened: Counter = Counter()
        pieces: list[tuple[int, str]] = []
        unclosed: set[str] = set()
        link, linked = False, 0

        def pop_to(place: int) -> None:
            while len(stack) > place:
                opened[stack.pop()[0]] -= 1

        def place_of(names, bounds=()) -> int:
            """The place of the nearest open element of the names within the bounds, or -1."""
            if not any(opened[n] > 0 for n in names):
                return -1
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in bounds:
                    return -1
            return -1

        def flush() -> None:
            nonlocal linked, pieces
            if pieces and any(not t.isspace() for _, t in pieces):
                block = next((n for t, n, _ in reversed(stack) if t in BLOCK), -1)
                self.blocks.append((block if block >= 0 else self.node(-1, "#"), pieces, linked))
            pieces, linked = [], 0

        at, end = 0, len(html)
        while at < end:
            m = TOKEN.match(html, at)
            tag, at = m[2], m.end()
            if tag is None:
                got = m[0]
                if (got[0] != "<" or got == "<") and not (stack and stack[-1][2]):
                    got = SPACES.sub(" ", entities.unescape(got) if "&" in got else got)
                    pieces.append((stack[-1][1] if stack else -1, got))
                    linked += len(got.strip()) if link else 0
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "br":
                    pieces.append((-1, " "))
                elif (k := place_of((tag,), () if tag in BLOCK else BLOCK)) >= 0:
                    if tag in BLOCK:
                        flush()
                    pop_to(k)
                if tag == "a" or tag in BLOCK:
                    link = False
                continue
            closed = m[3].rstrip().endswith("/") and (tag in FOREIGN or any(opened[f] for f in FOREIGN))
            if tag == "xmp" and tag not in unclosed:
                close = re.compile(r"</xmp\s*(?:>|\Z)", re.I).search(html, at)
                if close is None:
                    unclosed.add(tag)
                    continue
                flush()
                if not (stack and stack[-1][2]):
                    pieces.append((stack[-1][1] if stack else -1, SPACES.sub(" ", html[at : close.start()])))
                flush()
                at = close.end()
            elif closed:
                continue
            elif tag in RAW:
                if tag not in unclosed:
                    close = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(html, at)
                    if close is None:
                        unclosed.add(tag)
                        close_at = end if tag in ("script", "style", "textarea", "title") else at
                    at = close.end() if close else close_at
            elif tag == "br":
                pieces.append((-1, " "))
            elif tag in BLOCK:
                flush()
                link = False
                if tag in P_CLOSERS and (k := place_of(("p",))) >= 0:
                    pop_to(k)
                if tag in CLOSES and (k := place_of(*CLOSES[tag])) >= 0:
                    pop_to(k)
                label, hidden = self.label(tag, m[3])
                node = self.node(stack[-1][1] if stack else -1, label)
                if tag not in VOID:
                    stack.append((tag, node, hidden or bool(stack and stack[-1][2])))
                    opened[tag] += 1
            elif tag not in VOID:
                if tag == "a":
                    link = True
                label, hidden = self.label(tag, m[3])
                around = stack[-1][1] if stack else self.node(-1, "#")
                stack.append((tag, self.node(around, label) if label != tag else around, hidden or bool(stack and stack[-1][2])))
                opened[tag] += 1
        flush()

    @staticmethod
    def label(tag: str, rest: str) -> tuple[str, bool]:
        if not rest.strip():
            return tag, False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
        marks = [DIGITS.sub("", found[k].lower()) for k in ("class", "id", "role") if found.get(k)]
        hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        return ".".join([tag, *sorted(w for m in marks for w in m.replace(".", "-").split())]), hidden

    def signature(self) -> str:
        return "\n".join(f"{p} {label}" for p, label in self.nodes)


def text_of(pieces: list[tuple[int, str]], keep: list[bool] | None = None) -> str:
    """A block's text; with keep, without the pieces of nodes that are not kept."""
    return " ".join("".join(t for n, t in pieces if keep is None or n < 0 or keep[n]).split())


def parse_signature(signature: str | None) -> list[tuple[int, str]]:
    return [(int(p), label) for p, label in (line.split(" ", 1) for line in signature.split("\n"))] if signature else []


def chain(pairs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest chain of (x, y, weight) in which x and y both grow, and its weight; pairs come by x, y falling within an x.

    For each weight that a chain may reach, only chains that no lighter or equal one undercuts in their last y are kept.
    """
    ends: list[int] = []  # last y of the kept chains, growing with their weights
    best: list[tuple[int, int]] = []  # (weight, pair)
    before: list[int] = []
    for k, (_, y, w) in enumerate(pairs):
        at = bisect_right(ends, y - 1)
        total, link = (best[at - 1][0] + w, best[at - 1][1]) if at else (w, -1)
        before.append(link)
        last = at
        while last < len(ends) and best[last][0] <= total:
            last += 1
        if not (at < len(ends) and ends[at] == y and best[at][0] > total):
            ends[at:last], best[at:last] = [y], [(total, k)]
    out, k = [], best[-1][1] if best else -1
    while k >= 0:
        out.append(pairs[k][:2])
        k = before[k]
    return (best[-1][0] if best else 0), out[::-1]


def align(one: list[tuple[int, str]], other: list[tuple[int, str]]) -> list[int]:
    """Simple tree matching: for each node of one, the node of other that it matches in a largest top-down matching, or -1.

    Matching nodes have equal labels, matching parents, and keep the order of siblings. Pairs of nodes are found from the
    roots down and solved from the leaves up, without recursion; of equal matchings the first found counts.
    """
    if one == other:
        return [*range(len(one))]
    kids: list[list[list[int]]] = [[[] for _ in range(len(t) + 1)] for t in (one, other)]
    for k, t in zip(kids, (one, other), strict=True):
        for i, (p, _) in enumerate(t):
            k[p + 1].append(i)
    order, todo, below = [], [(-1, -1)], {}
    while todo:
        a, b = todo.pop()
        order.append((a, b))
        places: dict[str, list[int]] = {}
        for y in kids[1][b + 1]:
            places.setdefault(other[y][1], []).append(y)
        below[a, b] = [(x, y) for x in kids[0][a + 1] for y in reversed(places.get(one[x][1], ()))]
        todo += below[a, b]
    size: dict[tuple[int, int], int] = {}
    for pair in reversed(order):
        size[pair], below[pair] = chain([(x, y, 1 + size[x, y]) for x, y in below[pair]])
    out, todo = [-1] * len(one), [(-1, -1)]
    while todo:
        for x, y in below[todo.pop()]:
            out[x] = y
            todo.append((x, y))
    return out


def slots_of(nodes: list[tuple[int, str]], matched: list[int]) -> list[int]:
    """The slot of each node: the reference's node, or for what the reference lacks a (negative) hash of its path of labels."""
    paths, out = [], []
    for k, (parent, label) in enumerate(nodes):
        paths.append(digest(f"{paths[parent] if parent >= 0 else 0} {label}"))
        out.append(matched[k] if matched[k] >= 0 else -1 - (paths[k] & (1 << 62) - 1))
    return out


@lru_cache(100_000)
def says(name: str, words: frozenset[str]) -> bool:
    """Whether a name is one of the words, or one or more of them with parts that say where or what for."""
    if name in words:
        return True
    split = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in words for w in split) and all(w in words or w in STRONG_WORDS or w in WEAK_WORDS or w in PARTS for w in split)


def content_nodes(nodes: list[tuple[int, str]], stats: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which nodes of a page's tree hold content.

    stats: for each node's slot, over the distinct pages of the host, the pages that fill it, its characters, those in
    links, and those of constant blocks. The slot statistics decide first: a slot that is constant or mostly links is
    template. Names decide where statistics can't: by elements (nav, aside, footer, form and so on) and by words of class,
    id and role, of the node or of those around it. They say nothing about html, body and what wraps the article or main
    elements with most text, and about code; names of several parts (page-sidebar) say nothing about what holds most of the
    text. Within an article only names of adverts and comments decide; the others count for constant or link-heavy slots.
    Where article or main elements hold half of the text that is left or more, the content stands within them; else what
    stands outside is content too. If nothing would be left,
    statistics are dropped, then names.
    """
    n = len(nodes)
    chars, under, articles, inside = [s[1] for s in stats], [s[1] for s in stats], [0] * n, [False] * n
    links, constant = [s[2] for s in stats], [s[3] for s in stats]
    tags = [label.split(".", 1)[0] for _, label in nodes]
    code = [False] * n
    for k, (p, _) in enumerate(nodes):
        within = p >= 0 and inside[p]
        inside[k] = within or tags[k] in ARTICLE_TAGS
        code[k] = (p >= 0 and code[p]) or tags[k] in CODE_TAGS
        articles[k] = int(inside[k] and not within)
    outermost = sum(articles)
    for k in range(n - 1, -1, -1):
        if (p := nodes[k][0]) >= 0:
            for sums in (under, links, constant, articles):
                sums[p] += sums[k]
    total = sum(chars)

    def template(k: int) -> bool:
        """Constant, or mostly links, with all that stands below; own text for headings and paragraphs."""
        pages, own, own_links, own_constant = stats[k]
        if tags[k] in HEADINGS or tags[k] == "p":
            return pages >= CONSTANT_PAGES and own > 0 and own_constant >= own
        return under[k] > 0 and (links[k] > 0.6 * under[k] or constant[k] >= 0.9 * under[k])

    bad, linked = [False] * n, [False] * n
    for k, (p, label) in enumerate(nodes):
        _, *words = label.split(".")
        names = [w for w in words if not STATE.search(w)]
        wraps = tags[k] in ("html", "body", "main") or (outermost > 0 and articles[k] == outermost)
        if wraps or code[k]:
            names = []
        elif 2 * under[k] > total:
            names, wraps = [w for w in words if not re.search("[^a-z]", w)], tags[k] == "form"
        in_article = p >= 0 and inside[p]
        weak = any(says(w, WEAK_WORDS) for w in names) or tags[k] == "header"
        if in_article:
            named = any(says(w, ADVERT_WORDS) for w in names) or (tags[k] != "header" and (weak or any(says(w, STRONG_WORDS) for w in names)) and template(k))
        else:
            named = weak or any(says(w, STRONG_WORDS) for w in names)
        bad[k] = (p >= 0 and bad[p]) or (tags[k] in BOILER_TAGS and not (tags[k] == "form" and wraps)) or named
        linked[k] = (p >= 0 and linked[p]) or (not wraps and not in_article and template(k)) or (in_article and tags[k] not in HEADINGS and stats[k][0] >= CONSTANT_PAGES and links[k] > 0.8 * under[k] > 0)
    has_text = lambda keep: any(ok and c for ok, c in zip(keep, chars, strict=True))
    for keep in ([not b and not t for b, t in zip(bad, linked, strict=True)], [not b for b in bad], [not t for t in linked]):
        within = [ok and i for ok, i in zip(keep, inside, strict=True)]
        held = sum(c for ok, c in zip(within, chars, strict=True) if ok)
        if held and 2 * held >= sum(c for ok, c in zip(keep, chars, strict=True) if ok):
            return within
        if has_text(keep):
            return keep
    return [True] * n


def page_text(blocks: list, keep: list[bool], constant: set[tuple[int, int]]) -> str:
    """Kept blocks joined by one space, without those that are constant in their slot - unless little else is left (the host's pages are copies)."""
    kept = [(node, pieces, text) for node, pieces in blocks if keep[node] and (text := text_of(pieces, keep))]
    if constant:
        varied = [x for x in kept if (x[0], digest(text_of(x[1]))) not in constant]
        if sum(len(t) for *_, t in varied) >= 0.2 * sum(len(t) for *_, t in kept):
            kept = varied
    return " ".join(t for *_, t in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Every page is parsed into a tree of labelled elements; for each host the tree of most distinct pages (of equals, that
    with the largest hash) is the reference. Each other distinct tree of the host is aligned with it, pair by pair, so no
    task gathers a host's pages; joins on hosts and slots are salted. Slot statistics cover all pages, copies of one page
    counting once. Text is decoded, white space within a block becomes one space, kept blocks are joined by one space in
    page order. Texts are shuffled once, compressed.

    Null html counts as empty and gives an empty text. A null or malformed url has the host "". Pages of a host with fewer
    than three distinct pages have no constant slots. Repeated rows are extracted each; extra columns are not read; an empty table
    gives no rows; pages may be of any length and depth.
    """
    seen_columns = "host string, tree long, page long, node int, text long, chars int, linked int, sig string"

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each page a row with node -1 (and its tree, where the task has not yet sent it), and one for each block."""
        sent: set[tuple[str, int]] = set()
        for b in parts(batches):
            rows = []
            for host, html in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                page = Page(html)
                sig = page.signature()
                tree = digest(sig)
                texts = [(node, digest(text), len(text), linked) for node, pieces, linked in page.blocks if (text := text_of(pieces))]
                whole = digest(repr(texts))
                rows.append((host, tree, whole, -1, 0, 0, 0, None if (host, tree) in sent else sig))
                sent.add((host, tree))
                rows += [(host, tree, whole, node, text, n, linked, None) for node, text, n, linked in texts]
            if len(sent) > 100_000:
                sent.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows, strict=True)] or [()] * 8, kinds, strict=True)], [c.split()[0] for c in seen_columns.split(", ")])

    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.lower(host).alias("host"), F.col(html_col).cast("string").alias("html"))
    seen = materialise(rows.mapInArrow(survey, seen_columns))
    trees = checkpoint(seen.where("node = -1").groupBy("host", "tree").agg(F.max("sig").alias("sig"), F.count_distinct("page").alias("pages"), F.count("*").alias("copies")))
    reference = trees.groupBy("host").agg(F.max_by("sig", F.struct("pages", "tree")).alias("reference"), F.count("*").alias("n_trees"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            maps = []
            for x, y in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                own = parse_signature(x)
                maps.append(slots_of(own, align(own, parse_signature(y))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(maps, pa.list_(pa.int64()))], ["host", "tree", "sig", "copies", "slots"])

    matched = salted_join(trees.select("host", "tree", "sig", "copies"), checkpoint(reference), ["host"], "n_trees").select("host", "tree", "sig", "copies", "reference")
    matched = checkpoint(matched.mapInArrow(aligned, "host string, tree long, sig string, copies long, slots array<long>"))
    # one row for each distinct page, slot and text; then the slots' statistics and the texts that are constant in them
    blocks = salted_join(seen.where("node >= 0").drop("sig"), matched.select("host", "tree", "slots", "copies"), ["host", "tree"], "copies")
    blocks = blocks.select("host", F.expr("slots[node]").alias("slot"), "page", "text", "chars", "linked").groupBy("host", "slot", "page", "text").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    blocks = materialise(blocks)
    texts = blocks.groupBy("host", "slot", "text").agg(F.count("*").alias("of_text"), F.sum("chars").alias("of_chars")).where(F.col("of_text") >= CONSTANT_PAGES)
    stats = checkpoint(blocks.groupBy("host", "slot", "page").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).groupBy("host", "slot").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    constant = texts.join(stats, ["host", "slot"]).where(F.col("of_text") >= CONSTANT_SHARE * F.col("pages"))
    constant = constant.groupBy("host", "slot").agg(F.collect_list("text").alias("constant"), F.sum("of_chars").alias("constant_chars"))
    places = matched.select("host", "tree", F.posexplode("slots").alias("node", "slot"))
    used = checkpoint(places.groupBy("host", "slot").agg(F.count("*").alias("n_nodes")))
    stats = checkpoint(used.join(stats, ["host", "slot"], "left").join(constant, ["host", "slot"], "left"))
    of_node = F.struct("node", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("constant_chars", F.lit(0)).alias("constant_chars"), "constant")
    per_tree = salted_join(places, stats, ["host", "slot"], "n_nodes").groupBy("host", "tree").agg(F.collect_list(of_node).alias("stats"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            keeps, constants = [], []
            for sig, found in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                found = sorted(found or (), key=lambda s: s["node"])
                keeps.append(content_nodes(parse_signature(sig), [(s["pages"], s["chars"], s["linked"], s["constant_chars"]) for s in found]))
                constants.append([{"node": s["node"], "text": t} for s in found for t in s["constant"] or ()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(keeps, pa.list_(pa.bool_())), pa.array(constants, pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64())])))], ["host", "tree", "copies", "keep", "constant"])

    wrappers = matched.select("host", "tree", "sig", "copies").join(per_tree, ["host", "tree"], "left")
    wrappers = checkpoint(wrappers.mapInArrow(judged, "host string, tree long, copies long, keep array<boolean>, constant array<struct<node:int,text:long>>"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in parts(batches):
            got = [Page(h) for h in b.column(3).to_pylist()]
            packed = [z.compress(json.dumps([(n, p) for n, p, _ in page.blocks], ensure_ascii=False).encode("utf-8", "surrogatepass")) for page in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([digest(p.signature()) for p in got], pa.int64()), pa.array(packed, pa.binary())], ["id", "url", "host", "tree", "packed"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out = []
            for packed, keep, constant in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                out.append(page_text(json.loads(zstandard.decompress(packed)), keep or [], {(c["node"], c["text"]) for c in constant or ()}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([*map(len, out)], pa.int64())], ["id", "url", "text", "n_chars"])

    parsed = rows.mapInArrow(parse, "id long, url string, host string, tree long, packed binary")
    out = salted_join(parsed, wrappers, ["host", "tree"], "copies", "left").select("id", "url", "packed", "keep", "constant")
    return out.mapInArrow(render, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
