"""Replies of a model that propose selectors, tested on the pages that they are for.

Three kinds of replies: ``hunt`` looks for an item selector from nothing, ``improve`` changes a recipe (what it leaves out
stays), ``refine`` changes fields alone. Every proposal is measured on its page, next to the recipe that stands; the
best of those that beat it is adopted, and the others keep the reason why not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_walk import reply_json
from ..functions.scalars import match_form_of
from ..sources.dom import Tree
from ..sources.written import large, written
from .items import FIELDS
from .xpath import compile_path, find

#: Of how many items the fields are looked at, and how many recipes share one parse of their page.
JUDGED, BLOCK = 20, 64
RECIPE = "struct<proposal:string,kind:string,item:string,fields:map<string,string>,present:map<string,string>,examples:array<struct<field:string,needle:string>>>"
MEASURES = "page_id long, proposal string, item string, fields map<string,string>, hits int, filled map<string,int>, n_distinct int, n_examples int, ignored array<string>, found boolean, valid boolean"


def compiles(path: str) -> bool:
    try:
        compile_path(path)
    except ValueError:
        return False
    return True


def parsed(replies: DataFrame, text: str = "reply") -> DataFrame:
    """(page_id, proposal, kind, item, fields, reasoning, is_json) of replies; blank selectors count as left out.

    A refine reply's item selector is not read. Of rows that repeat a page's proposal the one with the smallest kind and text counts.
    """
    once = replies.where("page_id is not null and proposal is not null").groupBy("page_id", F.col("proposal").cast("string").alias("proposal")).agg(F.min(F.struct("kind", F.col(text).alias("reply"))).alias("r"))
    r = once.select("page_id", "proposal", "r.kind", reply_json(F.col("r.reply")).alias("t"))
    # a reply whose JSON is a list or a scalar proposes nothing
    r = r.withColumn("v", F.from_json(F.when(F.col("t").startswith("{"), F.col("t")), "map<string,string>"))
    of = lambda name: F.nullif(F.trim(F.col("v")[name]), F.lit(""))
    fields = F.map_filter(F.create_map(*[c for f in FIELDS for c in (F.lit(f), of(f"{f}_selector"))]), lambda k, v: v.isNotNull())
    item = F.when(F.col("kind") != "refine", of("item_selector"))
    return r.select("page_id", "proposal", "kind", item.alias("item"), fields.alias("fields"), F.coalesce(of("reasoning"), F.lit("")).alias("reasoning"), F.col("v").isNotNull().alias("is_json"))


def measure(tree: Tree, item: str, fields: dict[str, str], examples: list[dict]) -> tuple[int, dict[str, int], int, int]:
    """Hits of the item selector; over the first items, how often each field is filled, how many differ in title or link, and
    how many examples come out of them."""
    places = [pre for pre, _ in find(tree, item)]
    items = [{f: next((v for _, v in find(tree, p, pre)), "").strip() for f, p in fields.items()} for pre in places[:JUDGED]]
    seen = {(x.get("title", ""), x.get("link", "")) for x in items} - {("", "")}
    texts = {(f, match_form_of(v)) for x in items for f, v in x.items() if v}
    wanted = {(e["field"], match_form_of(e["needle"] or "")) for e in examples}
    return len(places), {f: sum(bool(x[f]) for x in items) for f in fields}, len(seen), len(wanted & texts)


def measured(pages: DataFrame, recipes: DataFrame, html_col: str = "html") -> DataFrame:
    """MEASURES of recipes (page_id and RECIPE's members), each on its page; a page is parsed once for a block of its recipes.

    Blocks are told by a hash within as many as the page's recipes ask for, so that a page with very many is dealt to many
    tasks. Field paths outside the subset are ignored: what stood before them, if anything, stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEASURES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.map_(pa.string(), pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
        for b in batches:
            rows = []
            for page, html, block in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                tree = Tree(html)
                for r in block:
                    proposed = dict(r["fields"] or ())
                    ignored = sorted(f for f, p in proposed.items() if not compiles(p))
                    fields = {f: p for f, p in {**dict(r["present"] or ()), **{f: p for f, p in proposed.items() if f not in ignored}}.items() if p and compiles(p)}
                    valid = bool(r["item"]) and compiles(r["item"])
                    got = measure(tree, r["item"], fields, r["examples"] or []) if valid else (0, {}, 0, 0)
                    rows.append((page, r["proposal"], r["item"], [*fields.items()], got[0], [*got[1].items()], got[2], got[3], ignored, html is not None, valid))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows, strict=True)] or [()] * len(kinds), kinds, strict=True)], names)

    count = recipes.groupBy("page_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = recipes.join(count, "page_id").withColumn("block", F.expr("pmod(xxhash64(proposal), blocks)"))
    blocks = dealt.groupBy("page_id", "block").agg(F.collect_list(F.struct("proposal", "kind", "item", "fields", "present", "examples").cast(RECIPE)).alias("recipes"))
    with_html = blocks.join(large(pages.select("page_id", F.col(html_col).cast("string").alias("html"))), "page_id", "left")
    return with_html.select(F.col("page_id").cast("long"), "html", "recipes").mapInArrow(run, MEASURES)


def judged(pages: DataFrame, present: DataFrame, replies: DataFrame, examples: DataFrame | None = None, html_col: str = "html") -> DataFrame:
    """One row per proposal: page_id, proposal, kind, item, fields, hits, n_filled, n_distinct, n_examples, confidence, ignored,
    reason, chosen.

    pages (page_id, html), present (page_id, item, fields map) and examples (page_id, field, needle) hold the page's recipe
    and values that it should give; replies are (page_id, proposal, kind, reply). A page may have no recipe. Recipes rank by
    distinct items, filled fields an item (both over the first 20), hits; of equals the smaller proposal. One that gives fewer of
    the examples than the present recipe, or ranks no higher, is rejected. ``reason`` is null for what beats it; ``chosen``
    marks the best of these. Replies with a null page_id or proposal give no row; an unknown page, a null html, an empty reply each
    give a reason. Parsed replies and measures are written to the checkpoint folder.
    """
    p = written(parsed(replies))
    known = present.where("page_id is not null").select("page_id", F.col("item").alias("old_item"), F.col("fields").alias("old_fields"))
    needles = None
    if examples is not None:
        needles = examples.groupBy("page_id").agg(F.collect_set(F.struct("field", "needle")).alias("examples"))
    standing = known.join(p.select("page_id").distinct(), "page_id", "left_semi").select("page_id", F.lit(None).cast("string").alias("proposal"), F.lit("present").alias("kind"), F.col("old_item").alias("item"), F.col("old_fields").alias("fields"))
    proposed = p.join(known, "page_id", "left").where("is_json").select("page_id", "proposal", "kind", F.when(F.col("kind") == "hunt", F.col("item")).otherwise(F.coalesce("item", "old_item")).alias("item"), "fields", F.when(F.col("kind") != "hunt", F.col("old_fields")).alias("present"))
    recipes = proposed.unionByName(standing, allowMissingColumns=True)
    none = F.array().cast("array<struct<field:string,needle:string>>")
    recipes = recipes.join(needles, "page_id", "left").withColumn("examples", F.coalesce("examples", none)) if needles is not None else recipes.withColumn("examples", none)
    m = written(measured(pages, recipes, html_col)).withColumn("n_filled", F.aggregate(F.map_values("filled"), F.lit(0), lambda a, x: a + x))
    share = F.when(F.col("hits") > 0, F.col("n_filled") / F.least("hits", F.lit(JUDGED))).otherwise(0.0)
    m = m.withColumn("rank", F.struct("n_distinct", share.alias("share"), "hits"))
    old = m.where("proposal is null").select("page_id", F.col("rank").alias("old_rank"), F.col("n_examples").alias("old_examples"))
    out = p.select("page_id", "proposal", "kind", "is_json").join(m.where("proposal is not null"), ["page_id", "proposal"], "left").join(old, "page_id", "left")
    reason = (
        F.when(~F.col("is_json"), "reply is not a JSON object").when(F.col("item").isNull(), "no item selector").when(~F.col("found"), "no page").when(~F.col("valid"), "invalid item selector")
        .when(F.col("hits") == 0, "no hits").when(F.col("n_filled") == 0, "no field filled").when(F.col("n_examples") < F.col("old_examples"), "examples lost").when(F.col("rank") <= F.col("old_rank"), "no better")
    )
    out = out.withColumn("reason", reason)
    best = out.where("reason is null").groupBy("page_id").agg(F.max(F.col("rank")).alias("rank"))
    first = out.where("reason is null").join(best, ["page_id", "rank"], "left_semi").groupBy("page_id").agg(F.min("proposal").alias("best"))
    confidence = F.when(F.col("hits") >= 2, 0.7).otherwise(0.3)
    return out.join(first, "page_id", "left").select("page_id", "proposal", "kind", "item", "fields", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n_filled", F.lit(0)).alias("n_filled"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"), confidence.alias("confidence"), F.coalesce("ignored", F.array().cast("array<string>")).alias("ignored"), "reason", F.coalesce(F.col("proposal") == F.col("best"), F.lit(False)).alias("chosen"))


def adopted(verdicts: DataFrame, present: DataFrame) -> DataFrame:
    """(page_id, item, fields, proposal): every page's recipe from now on; proposal is null where the present one stays."""
    new = verdicts.where("chosen").select("page_id", F.col("item").alias("new_item"), F.col("fields").alias("new_fields"), "proposal")
    both = present.select("page_id", "item", "fields").join(new, "page_id", "full")
    return both.select("page_id", F.coalesce("new_item", "item").alias("item"), F.coalesce("new_fields", "fields").alias("fields"), "proposal")
