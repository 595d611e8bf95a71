"""A subset of XPath, evaluated page by page: an item's fields lie within its page, so a scan parses once and shuffles nothing.

``//tag``, ``/tag``, ``.//tag``, ``descendant::tag``, ``*``, ``.``; predicates ``[@a='v']``, ``[contains(@a,'v')]``,
``[@a]``, ``[string-length(@a)>0]`` with ``and``; a last step ``/@a`` or ``/text()``; unions with ``|`` and parentheses.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow_udf
from ..sources.dom import Tree
from ..sources.written import large

STEP = re.compile(r"(//|/|^)(?:descendant::)?([\w-]+|\*|\.)((?:\[[^\]]*\])*)")
TEST = re.compile(r"contains\(\s*@([\w:-]+)\s*,\s*(['\"])(.*?)\2\s*\)|string-length\(\s*@([\w:-]+)\s*\)\s*>\s*0|@([\w:-]+)\s*=\s*(['\"])(.*?)\6|@([\w:-]+)")


@dataclass
class Step:
    deep: bool
    tag: str
    tests: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class Path:
    steps: list[Step]
    attr: str | None = None
    own_text: bool = False


@lru_cache(10_000)
def compile_path(text: str) -> list[Path]:
    """The branches of a path; raises ValueError where it is outside the subset."""
    out = []
    for branch in re.split(r"\|(?![^\[]*\])", text):
        b = branch.strip()
        while b.startswith("(") and b.endswith(")"):
            b = b[1:-1].strip()
        last = re.search(r"/(@[\w:-]+|text\(\))$", b)
        if last:
            b = b[: last.start()] or "."
        deep = b.startswith(("//", ".//", "descendant::"))
        b = re.sub(r"^(\.//|//|\./|descendant::)", "", b)
        path, at = Path([], last[1][1:] if last and last[1][0] == "@" else None, bool(last and last[1] == "text()")), 0
        while b not in (".", "") and at < len(b):
            m = STEP.match(b, at)
            if not m or m.end() == at:
                raise ValueError(f"not in the XPath subset: {text!r}")
            tests = []
            for predicate in re.findall(r"\[([^\]]*)\]", m[3]):
                for part in re.split(r"\s+and\s+", predicate):
                    t = TEST.fullmatch(part.strip())
                    if not t:
                        raise ValueError(f"not in the XPath subset: {text!r}")
                    tests.append(("has", t[1], t[3]) if t[1] else ("some", t[4], "") if t[4] else ("is", t[5], t[7]) if t[5] else ("set", t[8], ""))
            path.steps.append(Step(m[1] == "//" or (deep and not path.steps), m[2].lower(), tests))
            at = m.end()
        out.append(path)
    return out


def _ok(row: dict, step: Step) -> bool:
    if step.tag not in ("*", row["tag"]):
        return False
    test = {"has": lambda a, v: a is not None and v in a, "some": lambda a, v: bool(a), "is": lambda a, v: a == v, "set": lambda a, v: a is not None}
    return all(test[k](row["attrs"].get(n), v) for k, n, v in step.tests)


def find(tree: Tree, path: str, start: int = -1) -> list[tuple[int, str]]:
    """(pre, value) of the hits of a path from a node (-1: the document), in document order, each once."""
    out, rows = {}, tree.rows
    for p in compile_path(path):
        at = [start]
        for step in p.steps:
            hit, reached = [], -1
            for k in at:
                if not step.deep:
                    hit += [j for j in tree.children(k) if _ok(rows[j], step)]
                elif k < 0 or k > reached:  # what lies within a context that was searched is found already
                    reached = rows[k]["last"] if k >= 0 else len(rows)
                    hit += [j for j in tree.within(step.tag, k + 1, reached) if _ok(rows[j], step)]
            at = sorted(hit)
        for k in at:
            if k >= 0 and (p.attr is None or p.attr in rows[k]["attrs"]):
                out[k] = rows[k]["attrs"][p.attr] if p.attr else "".join(rows[k]["own"]) if p.own_text else tree.text(k)
    return sorted(out.items())


ROLES = ["title", "link", "content", "timestamp", "thumbnail", "author"]
EXTRACTED = "struct<items:array<struct<ord:int,title:string,link:string,content:string,timestamp:string,thumbnail:string,author:string>>,error:string>"


def items_of(tree: Tree, item: str, fields: dict[str, str], base: str | None = None, most: int | None = 100) -> list[dict]:
    """The first ``most`` items (None: all) of a page: each field is the stripped text or attribute of its first hit, "" without one.

    Relative links are joined to the page's URL where it is given.
    """
    out = []
    for k, (pre, _) in enumerate(find(tree, item)[:most]):
        got = {r: next((v for _, v in find(tree, p, pre)), "").strip() if p else "" for r, p in fields.items()}
        if base and got.get("link"):
            got["link"] = urljoin(base, got["link"])
        out.append({"ord": k} | got)
    return out


def scan(pages: DataFrame, item: str, fields: dict[str, str], most: int = 100, id_col: str = "page_id", html_col: str = "html", url_col: str | None = None) -> DataFrame:
    """One row per selected item, the first ``most`` of each page: page_id, ord, and the fields as text ("" where missing).

    A path outside the subset is an error when the query is built, not in its tasks.
    """
    for p in (item, *filter(None, fields.values())):
        compile_path(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases = b.column(2).to_pylist() if url_col else [None] * b.num_rows
            rows = [(i, x["ord"], *(x[f] for f in fields)) for i, h, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bases, strict=True) for x in items_of(Tree(h), item, fields, base, most)]
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * len(fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows, strict=True)] or [()] * len(kinds), kinds, strict=True)], ["page_id", "ord", *fields])

    read = pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string"), *[url_col] * bool(url_col))
    return large(read.mapInArrow(run, "page_id long, ord int" + "".join(f", {f} string" for f in fields)))


def _extracted(html: pd.Series, item: pd.Series, fields: pd.Series, base: pd.Series, most: int | None) -> pd.DataFrame:
    rows = []
    for h, i, f, u in zip(html, item, fields, base, strict=True):
        try:
            paths = json.loads(f or "{}")
            rows.append((items_of(Tree(h), i, {r: paths.get(r) or "" for r in ROLES}, u, most), None))
        except (ValueError, TypeError) as e:
            rows.append(([], str(e)))
    return pd.DataFrame(rows, columns=["items", "error"])


@arrow_udf(EXTRACTED)
def extract_items(html: pd.Series, item: pd.Series, fields: pd.Series, base: pd.Series) -> pd.DataFrame:
    """The first 100 items of a page by a recipe of its own (fields: JSON object of role and path); a bad path gives an error, not a failure."""
    return _extracted(html, item, fields, base, 100)


@arrow_udf(EXTRACTED)
def extract_every_item(html: pd.Series, item: pd.Series, fields: pd.Series, base: pd.Series) -> pd.DataFrame:
    """All items of a page, else like extract_items()."""
    return _extracted(html, item, fields, base, None)
