"""Scans that repair themselves: stored fingerprints of items, relocation after a page has changed, and the chain of fallbacks.

A recipe's scan falls through stages, each of which sees only what the ones before left open: the item selector as it
stands, the place that is most like the stored fingerprint, the selector recovered from an example text. Fields whose values
no longer resemble their examples get new paths. What changed comes out as a table of updated recipes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import match_form, meaningful_classes
from ..functions.udf import arrow_udf
from ..sources.dom import Tree, nodes
from ..sources.written import large, written
from . import selectors
from .items import FIELDS
from .xpath import extract_items, find

#: What a node is told by, with the weight of each kind of token. Tokens of the first kinds are rare within a page and
#: make a node a candidate; the others only count.
RARE = {"id": 4.0, "class": 3.0, "kids": 3.0, "attr": 2.0, "parent": 2.0, "role": 2.0}
COMMON = {"tag": 2.0, "in": 1.0, "kid": 1.0, "length": 0.5}
PRINT_COLUMNS = ("pre", "parent", "tag", "cls", "elem_id", "role", "attrs", "text", "parent_tag", "parent_cls")
NODE_COLUMNS = tuple(dict.fromkeys(PRINT_COLUMNS + selectors.STACK_COLUMNS + ("last",)))


@arrow_udf("array<int>")
def hit_places(html: pd.Series, path: pd.Series) -> pd.Series:
    """Where in the document a path's hits are; none for a path outside the subset."""

    def places(h: str | None, p: str | None) -> list[int]:
        try:
            return [pre for pre, _ in find(Tree(h), p)] if p else []
        except ValueError:
            return []

    return pd.Series([places(h, p) for h, p in zip(html, path, strict=True)])


def features(n: DataFrame) -> DataFrame:
    """(page_id, pre, tokens, and what a selector is made of): tag, classes, id, role, attribute names, parent, children, size of the text."""
    kids = n.groupBy("page_id", F.col("parent").alias("pre")).agg(F.array_sort(F.collect_set("tag")).alias("kids"))
    named = lambda kind, c: F.when(c != "", F.concat(F.lit(f"{kind}:"), c))
    listed = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{kind}:"), x))
    single = F.array_compact(F.array(
        named("tag", F.col("tag")), named("id", F.col("elem_id")), named("role", F.col("role")), named("in", F.col("parent_tag")),
        F.concat(F.lit("kids:"), F.array_join("kids", ",")), F.concat(F.lit("length:"), F.ceil(F.log2(F.length(F.trim("text")) + 1)).cast("string")),
    ))
    attrs = F.filter(F.map_keys("attrs"), lambda a: ~a.isin("class", "id", "role", "href", "src", "style"))
    tokens = F.array_distinct(F.concat(single, listed("class", meaningful_classes(F.col("cls"))), listed("parent", meaningful_classes(F.col("parent_cls"))), listed("kid", F.col("kids")), listed("attr", attrs)))
    return large(n.join(kids, ["page_id", "pre"], "left").select("page_id", "pre", "tag", "cls", "elem_id", "role", tokens.alias("tokens")))


def fingerprints(pages: DataFrame, recipes: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, print): what the first ``most`` hits of each recipe's item selector (page_id, item) have in common on its page."""
    read = large(pages).join(recipes.select("page_id", "item"), "page_id")
    hits = read.select("page_id", F.explode(F.slice(hit_places(F.col("html"), F.col("item")), 1, most)).alias("pre"))
    told = features(nodes(pages.join(recipes, "page_id", "left_semi"), *PRINT_COLUMNS)).join(hits, ["page_id", "pre"])
    return told.groupBy("page_id").agg(F.reduce(F.collect_list("tokens"), F.first("tokens"), lambda a, b: F.array_intersect(a, b)).alias("print"))


def weight(tokens: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in (RARE | COMMON).items() for x in kv])
    return F.aggregate(tokens, F.lit(0.0), lambda total, t: total + weights[F.substring_index(t, ":", 1)])


def relocated(n: DataFrame, prints: DataFrame, least: float = 0.45, margin: float = 0.05) -> DataFrame:
    """(page_id, selector, score, outcome): where the items of a stored fingerprint (page_id, print) are now.

    Nodes that share a rare token with the fingerprint are candidates; their likeness is the weight of shared tokens over
    that of all. Candidates are taken together by the selector that names them (class, id or role). The best selector wins
    (outcome ``relocated``) if it reaches ``least`` and is ``margin`` ahead of the next; else the outcome is ``tie``, or
    ``none`` where nothing reaches it.
    """
    rare = F.filter("print", lambda t: F.substring_index(t, ":", 1).isin(*RARE))
    near = features(n).join(prints, "page_id").where(F.arrays_overlap(rare, "tokens"))
    shared_weight = weight(F.array_intersect("tokens", "print"))
    cls1 = selectors.first_class(F.col("cls"))
    named = (cls1 != "") | (F.col("elem_id") != "") | (F.col("role") != "")
    scored = near.where(named).select("page_id", "pre", selectors.node_selector(F.col("tag"), cls1, F.col("elem_id"), F.col("role")).alias("selector"), (shared_weight / weight(F.array_union("tokens", "print"))).alias("score"))
    best = scored.groupBy("page_id", "selector").agg(F.max("score").alias("score"), F.min("pre").alias("pre"))
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "pre")
    top = best.withColumn("next", F.lead("score").over(order)).withColumn("k", F.row_number().over(order)).where("k = 1")
    outcome = F.when(F.col("score") < least, "none").when(F.col("score") - F.coalesce("next", F.lit(0.0)) < margin, "tie").otherwise("relocated")
    return top.select("page_id", "selector", "score", outcome.alias("outcome"))


def settled(recipes: DataFrame, pages: DataFrame, prints: DataFrame, least_siblings: int = 3, ratio: float = 0.9) -> DataFrame:
    """(page_id, stage, drift, selector, outcome) of recipes (page_id, item, example) over their pages (page_id, html).

    Stages: ``exact``, ``relocated``, ``recovered`` or ``none``. An example that the first 50 exact items do not hold makes
    them a poor match, which gives way to a recovered selector where there is one. A recovered selector must hit
    ``least_siblings`` nodes. Only pages that a stage leaves open are parsed for the next one.
    """
    read = recipes.select("page_id", "item", "example").join(large(pages.select("page_id", "html")), "page_id")
    exact = written(read.select("page_id", "item", "example", hit_texts(F.col("html"), F.col("item")).alias("texts")))
    wanted = match_form(F.coalesce("example", F.lit("")))
    poor = (wanted != "") & ~F.exists(F.slice("texts", 1, 50), lambda t: F.contains(t, F.col("wanted")))
    judged = written(exact.withColumn("wanted", wanted).select("page_id", "item", "example", (F.size("texts") > 0).alias("hit"), poor.alias("poor")))
    open_ = pages.join(judged.where("not hit or poor").select("page_id"), "page_id", "left_semi")
    n = written(nodes(open_, *NODE_COLUMNS))
    moved = written(relocated(n, prints.join(judged.where("not hit"), "page_id", "left_semi")))
    left = judged.join(moved.where("outcome = 'relocated'"), "page_id", "left_anti").where("not hit or poor")
    examples = left.where("coalesce(trim(example), '') <> ''").select("page_id", F.col("example").alias("needle"))
    again = selectors.recovered_selectors(open_, n, examples, least=ratio).where(F.col("sibling_count") >= least_siblings)
    out = judged.join(moved.withColumnRenamed("selector", "moved"), "page_id", "left").join(again.withColumnRenamed("selector", "again"), "page_id", "left")
    stage = F.when(F.col("outcome") == "relocated", "relocated").when(F.col("again").isNotNull(), "recovered").when(F.col("hit"), "exact").otherwise("none")
    chosen = F.when(stage == "relocated", F.col("moved")).when(stage == "recovered", F.col("again")).when(stage == "exact", F.col("item"))
    return out.select("page_id", stage.alias("stage"), stage.isin("relocated", "recovered").alias("drift"), chosen.alias("selector"), "outcome")


@arrow_udf("array<string>")
def hit_texts(html: pd.Series, path: pd.Series) -> pd.Series:
    """The compared forms of a path's hits, the first 100; none for a path outside the subset."""
    from ..functions.scalars import match_form_of

    def texts(h: str | None, p: str | None) -> list[str]:
        try:
            return [match_form_of(t) for _, t in find(Tree(h), p)[:100]] if p else []
        except ValueError:
            return []

    return pd.Series([texts(h, p) for h, p in zip(html, path, strict=True)])


def repaired_fields(pages: DataFrame, recipes: DataFrame, examples: DataFrame, ratio: float = 0.85) -> DataFrame:
    """(page_id, field, path): new paths of the fields of recipes (page_id, item, fields) whose values resemble no example (page_id, field, needle).

    The first three items decide whether a field is good. For the others the item that holds an example, of the first
    five, is searched (the one with the most text where none does); several paths become a union.
    """
    read = recipes.join(large(pages.select("page_id", "html")), "page_id")
    found = read.select("page_id", F.explode(extract_items(F.col("html"), F.col("item"), F.to_json("fields"), F.lit(None).cast("string"))["items"]).alias("i"))
    cells = found.select("page_id", "i.ord", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("i")[f].alias("value")) for f in FIELDS])).alias("c")).select("page_id", "ord", "c.*")
    bad = written(examples.join(selectors.already_good(large(cells), examples, "page_id").where("not good").select("page_id", "field"), ["page_id", "field"]))
    searched = pages.join(bad, "page_id", "left_semi")
    n = nodes(searched, "pre", "last", "text")
    firsts = read.join(bad, "page_id", "left_semi").select("page_id", "item", F.posexplode(F.slice(hit_places(F.col("html"), F.col("item")), 1, 5)).alias("k", "pre"))
    placed = firsts.join(n.select("page_id", "pre", "last", "text"), ["page_id", "pre"])
    holds = placed.join(bad.groupBy("page_id").agg(F.collect_set(F.lower("needle")).alias("needles")), "page_id").withColumn("holds", F.exists("needles", lambda x: F.contains(F.lower("text"), x)))
    best = F.struct(~F.col("holds"), F.when(F.col("holds"), F.col("k")).otherwise(-F.length("text")), "k")
    items = holds.groupBy("page_id").agg(F.min_by(F.struct("item", "pre", "last"), best).alias("b")).select("page_id", "b.*")
    paths = selectors.recovered_fields(searched, items, bad.select("page_id", "field", "needle"), least=ratio)
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"])
    union = F.array_join(F.transform("paths", lambda p: F.concat(F.lit("("), p, F.lit(")"))), " | ")
    return paths.groupBy("page_id", "field").agg(ranked.alias("paths")).select("page_id", "field", F.when(F.size("paths") == 1, F.col("paths")[0]).otherwise(union).alias("path"))


def updated_recipes(recipes: DataFrame, chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """recipes (page_id, item, fields) with the selectors that settled() chose and the paths that repaired_fields() found."""
    new = paths.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "path"))).alias("new"))
    out = recipes.join(chosen.where("selector is not null").select("page_id", "selector", "stage", "drift"), "page_id").join(new, "page_id", "left")
    kept = F.map_filter("fields", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys("new"), k), F.lit(False)))
    return out.select("page_id", F.col("selector").alias("item"), F.when(F.col("new").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "new")).alias("fields"), "stage", "drift")


def repairing_scan(recipes: DataFrame, pages: DataFrame, prints: DataFrame, field_examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, updated recipes) of recipes (page_id, item, example, fields) over changed pages; the stored recipes stay as they are."""
    chosen = written(settled(recipes, pages, prints))
    open_recipes = recipes.select("page_id", "fields").join(chosen.where("selector is not null").select("page_id", F.col("selector").alias("item")), "page_id")
    updated = written(updated_recipes(recipes.select("page_id", "fields"), chosen, repaired_fields(pages, open_recipes, field_examples)))
    read = updated.join(large(pages.select("page_id", "html")), "page_id")
    return read.select("page_id", F.explode(extract_items(F.col("html"), F.col("item"), F.to_json("fields"), F.lit(None).cast("string"))["items"]).alias("i")).select("page_id", "i.*"), updated
