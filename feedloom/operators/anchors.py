"""Anchors of one page: computed where it is parsed, so that no node is shuffled, kept or broadcast, however many pages there are.

Each function takes the tree of a page; per_page() runs one over a relation of pages. Selectors, classes and dates follow the
column expressions of ``functions.scalars`` and ``selectors``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scalars import match_form_of
from ..sources.dom import ARROW, Tree
from ..sources.written import large

#: Blanks and digits are those of ASCII, as to the engine's expressions.
SPACE = r"[ \t\n\x0b\f\r]"
SPACES = re.compile(SPACE + "+")
DATED = re.compile("|".join(L.DATES).replace(r"\d", "[0-9]").replace(r"\s", SPACE))
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
VARIANT, EXACT, COMPOUND, PREFIX = re.compile(L.UTILITY_VARIANT), frozenset(["", *L.UTILITY_EXACT]), re.compile(L.UTILITY_COMPOUND.replace(r"\d", "[0-9]")), re.compile("|".join(L.UTILITY_PREFIXES))
KINDS = ARROW | {"long": pa.int64()}
#: pages parsed before their rows leave
PIECE = 200


def per_page(pages: DataFrame, run: Callable[..., Iterable[tuple]], schema: str, carry: str | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, schema): the rows that ``run`` makes of each page's tree, and of one carried column where it is named."""
    names, kinds = zip(*[c.split(" ") for c in schema.split(", ")], strict=True)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                ids, htmls, *more = [c.to_pylist() for c in b.slice(at, PIECE).columns]
                rows = [(i, *row) for i, h, *x in zip(ids, htmls, *more, strict=True) for row in run(Tree(h), *x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows, strict=True)] or [()] * (1 + len(kinds)), [pa.int64(), *(KINDS[k] for k in kinds)], strict=True)], ["page_id", *names])

    return large(pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string"), *[carry] * bool(carry)).mapInArrow(made, "page_id long, " + schema))


def with_examples(pages: DataFrame, examples: DataFrame, *columns: str) -> DataFrame:
    """pages (page_id, html) that have examples, with these (page_id and the columns) as one array each; joined by sorting."""
    of = large(examples.groupBy("page_id").agg(F.collect_list(F.struct(*columns)).alias("examples")))
    return large(pages.select("page_id", "html")).join(of, "page_id")


def bounded(text: str) -> str:
    """The text with a letter or a mark for each character beyond ASCII, so that words end where they do for the engine: letters,
    decimal digits and the marks upon them belong to a word."""
    if text.isascii():
        return text
    out, word = [], False
    for c in text:
        kind = unicodedata.category(c)
        word = kind[0] == "L" or kind == "Nd" or (kind == "Mn" and word)
        out.append(c if c.isascii() else "é" if word else "§")
    return "".join(out)


def is_dated(text: str) -> bool:
    return DATED.search(bounded(text.lower())) is not None


def length_without_dates(text: str) -> int:
    """How long a text is without dates and the blanks around it."""
    return len(DATED.sub("", bounded(text.translate(ASCII_LOWER))).strip(" "))


@lru_cache(10_000)
def first_class(cls: str) -> str:
    """The first class that is no layout helper, block-element-modifier names first; "" without one."""

    def helper(c: str) -> bool:
        bare = VARIANT.sub("", c)
        return bare in EXACT or bool(COMPOUND.search(bare) or PREFIX.match(bare))

    kept = [c for c in SPACES.split(cls.strip(" ")) if not helper(c)]
    return next((c for c in kept if "__" in c or "--" in c), kept[0] if kept else "")


def class_of(row: dict) -> str:
    return first_class(row["attrs"].get("class", ""))


def by_class(tag: str, cls: str) -> str:
    return f"{tag}[contains(@class,'{cls}')]"


def node_selector(row: dict) -> str:
    """A selector of a node: by class, else id, else role, else tag alone."""
    if cls := class_of(row):
        return "//" + by_class(row["tag"], cls)
    for name in ("id", "role"):
        if row["attrs"].get(name):
            return f"//{row['tag']}[@{name}='{row['attrs'][name]}']"
    return "//" + row["tag"]


def deepest_hits(tree: Tree, forms: list[str], needles: Iterable[str | None]) -> list[int]:
    """The nodes whose text, in its compared form, holds a needle while no child's does, once for each needle held; blank needles hit nothing."""
    wanted = [w for n in needles if n is not None and (w := match_form_of(n))]
    hits = [k for k, form in enumerate(forms) for w in wanted if w in form]
    above = {tree.rows[k]["parent"] for k in hits}
    return [k for k in hits if k not in above]


def forms_of(tree: Tree) -> list[str]:
    return [match_form_of(tree.text(k)) for k in range(len(tree.rows))]


def date_anchors(pages: DataFrame) -> DataFrame:
    """(page_id, selector, item_count, confidence, exemplar): candidates.date_anchors() of pages (page_id, html)."""
    found = per_page(pages, lambda tree: filter(None, [date_anchor(tree)]), "selector string, item_count long, exemplar int")
    return found.select("page_id", "selector", "item_count", F.round(F.least(F.lit(0.9), 0.55 + 0.05 * F.col("item_count")), 2).alias("confidence"), "exemplar")


def date_anchor(tree: Tree) -> tuple[str, int, int] | None:
    """(selector, item_count, exemplar): candidates.date_anchors() of one page."""
    rows = tree.rows
    dated = [k for k, r in enumerate(rows) if "datetime" in r["attrs"] or (r["own"] and is_dated("".join(r["own"])))]
    dated += [r["parent"] for r in rows if r["parent"] >= 0 and r["tail"] and is_dated("".join(r["tail"]))]
    holders: set[int] = set()
    for k in dated:
        while k >= 0 and k not in holders:
            holders.add(k)
            k = rows[k]["parent"]
    kind = {k: (rows[k]["parent"], rows[k]["tag"], class_of(rows[k])) for k in holders if rows[k]["parent"] >= 0}
    like = Counter(kind.values())
    nearest = set()
    for k in {*dated}:
        while k >= 0 and like[kind.get(k)] < 3:
            k = rows[k]["parent"]
        nearest.add(k)
    kinds = defaultdict(list)
    for k in sorted(nearest - {-1}):
        kinds[kind[k][1:]].append(k)
    most = max(((len(ks), -ks[0]) for ks in kinds.values() if len(ks) >= 3), default=None)
    if not most:
        return None
    best = kind[-most[1]]
    linked: set[int] = set()
    for k in tree.by_tag.get("a", ()):
        if "href" in rows[k]["attrs"]:
            while k >= 0 and k not in linked:
                linked.add(k)
                k = rows[k]["parent"]
    valid = [k for k, of in kind.items() if of == best and k in linked and length_without_dates(tree.text(k)) >= 20]
    tag, cls = best[1:]
    return ("//" + (by_class(tag, cls) if cls else tag), len(valid), min(valid)) if len(valid) >= 3 else None


def item_fields(tree: Tree, top: int) -> tuple[str, str, str, str] | None:
    """(title, link, timestamp, guessed_title): relative selectors from what an exemplar item holds.

    title: the first of h1 to h4 that is there, else a link; timestamp: a time element, another datetime attribute, or the
    first dated node, by its class. guessed_title looks for h2, h3, h4, h1 in this order.
    """
    inside = tree.rows[top + 1 : tree.rows[top]["last"] + 1]
    if not inside:
        return None
    tags, stamped = {r["tag"] for r in inside}, [r for r in inside if "datetime" in r["attrs"]]
    linked = any(r["tag"] == "a" and "href" in r["attrs"] for r in inside)
    title = next((f".//{h}" for h in ("h1", "h2", "h3", "h4") if h in tags), ".//a" if linked else "")
    guess = next((f"descendant::{h}" for h in ("h2", "h3", "h4", "h1") if h in tags), "descendant::a")
    if stamped:
        stamp = ".//time/@datetime" if any(r["tag"] == "time" for r in stamped) else ".//*/@datetime"
    else:
        first = next((r for r in inside if r["own"] and is_dated("".join(r["own"]))), None)
        stamp = "" if first is None else ".//" + (by_class(first["tag"], c) if (c := class_of(first)) else first["tag"])
    return title, ".//a/@href" if linked else "", stamp, guess


def example_anchors(pages: DataFrame, examples: DataFrame, steps: int = 8) -> DataFrame:
    """(page_id, selector, item_count, n_fields): candidates.example_anchor() of pages (page_id, html), from examples (page_id, field, needle)."""
    found = lambda tree, of: filter(None, [example_anchor(tree, of, steps)])
    return per_page(with_examples(pages, examples, "field", "needle"), found, "selector string, item_count long, n_fields long", "examples")


def example_anchor(tree: Tree, examples: list[dict], steps: int = 8) -> tuple[str, int, int] | None:
    """(selector, item_count, n_fields): candidates.example_anchor() of one page, from examples (field, needle)."""
    rows, low = tree.rows, [tree.text(k).lower() for k in range(len(tree.rows))]
    deepest: dict[str, tuple[int, int]] = {}
    for e in examples:
        wanted = e["needle"].lower() if e["needle"] is not None else None
        found = [(-rows[k]["depth"], k) for k, t in enumerate(low) if wanted is not None and wanted in t]
        if found:
            deepest[e["field"]] = min([*found, *filter(None, [deepest.get(e["field"])])])
    if not deepest:
        return None
    line = common_path(tree, [k for _, k in deepest.values()])
    for k in reversed(line[-steps - 1 :]):
        r = rows[k]
        n = sum(rows[j]["tag"] == r["tag"] and class_of(rows[j]) == class_of(r) for j in tree.children(r["parent"]))
        if n >= 2:
            cls, role = class_of(r), r["attrs"].get("role", "")
            return f"//{r['tag']}" + (f"[contains(@class,'{cls}')]" if cls else f"[@role='{role}']" if role else ""), n, len(deepest)
    return None


def common_path(tree: Tree, places: Iterable[int]) -> list[int]:
    """The common ancestors of nodes, themselves included, from the root."""
    return [x[0] for x in zip(*map(tree.path, places)) if len({*x}) == 1]  # two paths agree exactly as far as their common ancestors


def reanchored(tree: Tree, needles: list[str | None], steps: int = 8, most: int = 3) -> list[tuple[int, str]]:
    """(rank, selector): item selectors from example texts, those found first in the page first.

    From each deepest hit, the nearest node upward within ``steps`` that has a sibling of its tag is an item.
    """
    rows, first, tags = tree.rows, {}, Counter((r["parent"], r["tag"]) for r in tree.rows)
    for leaf in deepest_hits(tree, forms_of(tree), needles):
        for k in tree.path(leaf)[: -steps - 1 : -1]:
            if rows[k]["parent"] >= 0 and tags[rows[k]["parent"], rows[k]["tag"]] >= 2:
                first.setdefault(node_selector(rows[k]), leaf)
                break
    return [(rank, s) for rank, (_, s) in enumerate(sorted((leaf, s) for s, leaf in first.items())[:most], 1)]


def row_anchors(tree: Tree, examples: list[dict], most_hits: int = 8, most_combos: int = 200, steps: int = 8) -> list[tuple]:
    """(row, selector, item_count, n_fields, reps, fields): selectors.row_anchors() of one page, from examples (row, field, needle)."""
    rows, forms, out = tree.rows, forms_of(tree), []
    of = defaultdict(lambda: defaultdict(list))
    for e in examples:
        if e["row"] is not None and e["field"] is not None:
            of[e["row"]][e["field"]].append(e["needle"])
    links = [(k, href) for k in tree.by_tag.get("a", ()) if (href := rows[k]["attrs"].get("href"))]
    alike: dict[int, Counter] = {}

    def reps(k: int) -> int:
        parent = rows[k]["parent"]
        if parent < 0:
            return 1
        if parent not in alike:
            alike[parent] = Counter((rows[j]["tag"], class_of(rows[j])) for j in tree.children(parent))
        return alike[parent][rows[k]["tag"], class_of(rows[k])]

    for row, fields in of.items():
        roles = []
        for name, needles in fields.items():
            if name == "link":
                hits = sorted(k for n in needles if (w := (n or "").strip(" ")) for k, href in links if w in href or href in w)
            else:
                hits = deepest_hits(tree, forms, needles)
            if hits:
                roles.append((min(len(hits), most_hits), name, hits[:most_hits]))
        roles.sort()
        best = None
        for combo in islice(product(*[hits for _, _, hits in roles]), most_combos) if roles else ():
            line = common_path(tree, combo)[: -steps - 2 : -1]
            if line:
                block = next((k for k in line[:steps] if reps(k) >= 2), line[-1])
                score = reps(block) * 10 + len(combo) * 5 - (rows[block]["last"] - block + 1) * 0.02
                if best is None or score > best[0]:
                    best = (score, block, combo)
        if best is None:
            continue
        _, block, combo = best
        r, cls = rows[block], class_of(rows[block])
        test = (lambda a: cls in a.get("class", "")) if cls else next(((lambda a, n=n: a.get(n) == r["attrs"][n]) for n in ("id", "role") if r["attrs"].get(n)), lambda a: True)
        count = sum(test(rows[k]["attrs"]) for k in tree.by_tag[r["tag"]])
        paths = {}
        for name, k in sorted(zip([name for _, name, _ in roles], combo, strict=True)):
            chain = [j for j in reversed(tree.path(k)) if j > block]
            if chain:
                named = next((by_class(rows[j]["tag"], c) for j in chain if (c := class_of(rows[j]))), rows[chain[0]]["tag"])
                paths[name] = f".//{named}" + ("/@href" if name == "link" else "")
        out.append((row, node_selector(r), count, len(combo), reps(block), [*paths.items()]))
    return out
