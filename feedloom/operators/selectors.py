"""Selectors from examples: sub-selectors of an item, re-anchoring, recovery after a page has changed, anchors of whole example rows.

Nodes, matches and ancestors are relations; steps are joins on the page, groupings and windows. Small Arrow helpers compare
texts and count the hits of a path.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import form_ratio, match_form, meaningful_classes, profile, ratio_bound, similarity_from
from ..functions.udf import arrow_udf
from ..sources.dom import Tree, nodes
from ..sources.written import large, written
from . import anchors
from .xpath import find

#: Elements whose name alone tells a field, and the attributes that identify a level of a selector stack.
SEMANTIC = ["h1", "h2", "h3", "h4", "h5", "h6", "time", "a", "img"]
STACK_ATTRS, LONGEST_ATTR = ["class", "data-testid", "id", "itemprop", "itemtype", "role"], 50
STACK_COLUMNS = ("pre", "parent", "tag", "cls", "elem_id", "role", "attrs", "text", "path")


@arrow_udf("int")
def count_hits(html: pd.Series, path: pd.Series) -> pd.Series:
    """How many nodes of a page a path selects; a path outside the subset selects none."""

    def count(h: str | None, p: str | None) -> int:
        try:
            return len(find(Tree(h), p)) if p else 0
        except ValueError:
            return 0

    return pd.Series([count(h, p) for h, p in zip(html, path, strict=True)], dtype="int32")


@arrow_udf("int")
def hit_rate(html: pd.Series, item: pd.Series, path: pd.Series) -> pd.Series:
    """In how many items of a page the first hit of a relative path has text."""

    seen, tree = None, Tree(None)  # the rows of one page mostly follow each other

    def count(h: str | None, i: str, p: str) -> int:
        nonlocal seen, tree
        if h != seen:
            seen, tree = h, Tree(h)
        firsts = (next((v for _, v in find(tree, p, pre)), "") for pre, _ in find(tree, i))
        return sum(bool(v.strip()) for v in firsts)

    return pd.Series([count(*x) for x in zip(html, item, path, strict=True)], dtype="int32")


def first_class(cls: Column) -> Column:
    return F.coalesce(F.try_element_at(meaningful_classes(cls), F.lit(1)), F.lit(""))


def by_class(tag: Column, cls: Column) -> Column:
    return F.concat(tag, F.lit("[contains(@class,'"), cls, F.lit("')]"))


def node_selector(tag: Column, cls1: Column, elem_id: Column, role: Column) -> Column:
    """A selector of a node: by class, else id, else role, else tag alone."""
    by = lambda name, c: F.concat(F.lit("//"), tag, F.lit(f"[@{name}='"), c, F.lit("']"))
    return F.when(cls1 != "", F.concat(F.lit("//"), by_class(tag, cls1))).when(elem_id != "", by("id", elem_id)).when(role != "", by("role", role)).otherwise(F.concat(F.lit("//"), tag))


def derived_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, link, timestamp, guessed_title): relative selectors from the first item of each page's date anchor."""
    first = lambda tree: (f for a in [anchors.date_anchor(tree)] if a and (f := anchors.item_fields(tree, a[2])))
    return anchors.per_page(pages, first, "title string, link string, timestamp string, guessed_title string")


def deepest_hits(nodes: DataFrame, examples: DataFrame, by: list[str]) -> DataFrame:
    """examples (page_id, …, needle) with the nodes whose text holds the needle while no child's does; blank needles hit nothing."""
    wanted = examples.withColumn("needle_form", match_form(F.col("needle"))).where("needle_form <> ''")
    hits = nodes.join(examples.select("page_id").distinct(), "page_id", "left_semi").withColumn("form", match_form(F.col("text"))).join(wanted, "page_id").where(F.contains("form", "needle_form"))
    above = hits.select(*by, F.col("parent").alias("pre")).distinct().withColumn("has_inner", F.lit(True))
    return hits.join(above, [*by, "pre"], "left").where("has_inner is null").drop("has_inner", "form", "needle_form")


def reanchor(pages: DataFrame, examples: DataFrame, steps: int = 8, most: int = 3) -> DataFrame:
    """(page_id, rank, selector): item selectors from an example text (page_id, needle), those found first in the page first.

    From each deepest hit, the nearest node upward within ``steps`` that has a sibling of its tag is an item.
    """
    found = lambda tree, of: anchors.reanchored(tree, [e["needle"] for e in of], steps, most)
    return anchors.per_page(anchors.with_examples(pages, examples, "needle"), found, "rank int, selector string", "examples")


def sibling_index(nodes: DataFrame) -> DataFrame:
    """nodes with their place, from 0, among the siblings of equal tag, class, id and role."""
    same = Window.partitionBy("page_id", "parent", "tag", "cls", "elem_id", "role").orderBy("pre")
    return nodes.withColumn("sibling_index", (F.row_number().over(same) - 1).cast("int"))


def stacks(nodes: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """leaves (by, path) with the path of elements from the root down to each, by their identifying attributes: (by, leaf, xpath)."""
    value = lambda k: F.when(F.length(F.col("attrs")[k]).between(1, LONGEST_ATTR), F.col("attrs")[k])
    tests = F.array_compact(F.array(*[F.concat(F.lit("contains(@class,'"), F.split(F.trim(value(k)), r"\s+")[0], F.lit("')")) if k == "class" else F.concat(F.lit(f"@{k}='"), value(k), F.lit("'")) for k in STACK_ATTRS]))
    level = F.concat("tag", F.when(F.size(tests) > 0, F.concat(F.lit("["), F.array_join(tests, " and "), F.lit("]"))).otherwise(""))
    up = leaves.select(*by, F.col("pre").alias("leaf"), F.posexplode("path").alias("depth", "pre"))
    frames = up.join(nodes.select("page_id", "pre", level.alias("level")), ["page_id", "pre"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "level"))), lambda x: x["level"]), "/")
    return frames.groupBy(*by, "leaf").agg(F.concat(F.lit("//"), joined).alias("xpath"))


def candidate_pairs(rows: DataFrame, text: str, examples: DataFrame, on: list[str], least: float) -> DataFrame:
    """rows joined to the examples (on, needle) that their text may be like, by a bound on the ratio that needs no Python.

    Each text and needle is brought to its compared form once; pairs whose lengths or characters rule out ``least`` go.
    """
    some = rows.join(examples.select(*on).distinct(), on, "left_semi").withColumn("__form", match_form(F.col(text))).withColumn("__profile", profile(F.col("__form")))
    wanted = examples.withColumn("__needle", match_form(F.coalesce("needle", F.lit("")))).withColumn("__wanted", profile(F.col("__needle")))
    return some.join(wanted, on).where(ratio_bound(F.col("__profile"), F.col("__wanted")) >= least - 1e-9)


def similar_pairs(rows: DataFrame, text: str, examples: DataFrame, on: list[str], least: float) -> DataFrame:
    """rows joined to the examples (on, needle) that their text is like, with their ratio: filtered by its bound, then verified."""
    verified = candidate_pairs(rows, text, examples, on, least).withColumn("ratio", form_ratio(F.col("__form"), F.col("__needle")))
    return verified.where(F.col("ratio") >= least).drop("__form", "__profile", "__needle", "__wanted")


def recovered_selectors(pages: DataFrame, nodes: DataFrame, examples: DataFrame, least: float = 0.9, most: int = 10, longest: int = 500) -> DataFrame:
    """(page_id, selector, sibling_count): the best selector of the element whose text is like the example's (page_id, needle).

    Innermost elements of at most ``longest`` characters that match by ``least`` are candidates, the first ``most`` of a
    page; the selector that hits most nodes wins, the shorter of equals.
    """
    short = nodes.where(F.length(F.trim("text")).between(1, longest)).select("page_id", "pre", "parent", "text")
    like = written(similar_pairs(short, "text", examples, ["page_id"], least).select("page_id", "pre", "parent").distinct())  # compared once; an element counts once, however many examples it is like
    inner = like.select("page_id", F.col("parent").alias("pre")).distinct().withColumn("inner", F.lit(True))
    leaves = like.join(inner, ["page_id", "pre"], "left").where("inner is null")
    leaves = leaves.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))).where(F.col("k") <= most)
    leaves = leaves.join(nodes.select("page_id", "pre", "path"), ["page_id", "pre"])
    found = stacks(nodes, leaves, ["page_id"]).groupBy("page_id", "xpath").agg(F.min("leaf").alias("leaf"))
    counted = found.join(large(pages.select("page_id", "html")), "page_id").withColumn("sibling_count", count_hits(F.col("html"), F.col("xpath")))
    best = counted.groupBy("page_id").agg(F.max_by(F.struct("xpath", "sibling_count"), F.struct("sibling_count", -F.length("xpath"), -F.col("leaf"))).alias("b"))
    return best.select("page_id", F.col("b.xpath").alias("selector"), F.col("b.sibling_count").alias("sibling_count"))


def recovered_fields(pages: DataFrame, items: DataFrame, examples: DataFrame, least: float = 0.85) -> DataFrame:
    """(page_id, field, rank, path, hits): relative paths of fields within an item, from examples (page_id, field, needle).

    ``items`` has (page_id, item, pre, last): a page's item selector and the item that holds the examples. Elements of the item
    that are like an example give a path each, by a telling tag where it is the only one, else by the chain of classes; the one
    with text in most items stands for the example, and the examples' paths are ranked by their hits. All elements and items
    count; a path that several elements share is tried once. Pages meet their items before they are parsed, so no node outside
    of these is shuffled, and what is left of an item is written once.
    """
    placed = large(pages.select("page_id", "html")).join(items.select("page_id", F.struct("item", "pre", "last").alias("of")), "page_id")
    inside = nodes(placed, "pre", "tag", "attrs", "cls", "text", "path", carry="of", within=True)
    own = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (F.col("text"), F.col("attrs")["href"], F.col("attrs")["src"], F.col("attrs")["datetime"], F.col("attrs")["content"])])
    inside = inside.select("page_id", "pre", "tag", "cls", "path", own.alias("own"), F.col("of.item").alias("item"), F.col("of.pre").alias("top"))
    inside = written(inside.withColumn("same_tag", F.count("*").over(Window.partitionBy("page_id", "tag"))))
    like = similar_pairs(inside.where("own is not null"), "own", examples, ["page_id"], least)
    level = F.concat("tag", F.when(F.col("cls") != "", F.concat(F.lit("[contains(@class,'"), F.split(F.trim("cls"), r"\s+")[0], F.lit("')]"))).otherwise(""))
    up = like.select("page_id", "field", "needle", "pre", "top", F.posexplode("path").alias("depth", "above")).where("above > top")
    levels = up.join(inside.select("page_id", F.col("pre").alias("above"), level.alias("level")), ["page_id", "above"])
    generic = levels.groupBy("page_id", "field", "needle", "pre").agg(F.concat(F.lit(".//"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "level"))), lambda x: x["level"]), "/")).alias("generic"))
    paths = like.join(generic, ["page_id", "field", "needle", "pre"]).withColumn("path", F.when(F.col("tag").isin(SEMANTIC) & (F.col("same_tag") == 1), F.concat(F.lit(".//"), "tag")).otherwise(F.col("generic")))
    paths = paths.groupBy("page_id", "field", "needle", "item", "path").agg(F.min("pre").alias("pre"))
    rated = paths.join(large(pages.select("page_id", "html")), "page_id").withColumn("hits", hit_rate(F.col("html"), F.col("item"), F.col("path")))
    best = rated.groupBy("page_id", "field", "needle").agg(F.max_by(F.struct("path", "hits"), F.struct("hits", -F.col("pre"))).alias("b"))
    each = best.groupBy("page_id", "field", "b.path").agg(F.max("b.hits").alias("hits"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("page_id", "field").orderBy(F.desc("hits"), "path"))).select("page_id", "field", "rank", "path", "hits")


def poor_match(items: DataFrame, examples: DataFrame, by: str, most: int = 50) -> DataFrame:
    """(by, needle, poor): whether none of the first items (by, ord, text) holds the example (by, needle)."""
    held = examples.join(items.where(F.col("ord") < most), by, "left").withColumn("hit", F.contains(match_form(F.col("text")), match_form(F.col("needle"))))
    return held.groupBy(by, "needle").agg((~F.coalesce(F.max("hit"), F.lit(False))).alias("poor"))


def already_good(items: DataFrame, examples: DataFrame, by: str, most: int = 3, least: float = 0.75) -> DataFrame:
    """(by, field, good): whether a field of one of the first items (by, ord, field, value) is like an example (by, field, needle) or one holds the other."""
    near = examples.join(items.where((F.col("ord") < most) & (F.col("value") != "")), [by, "field"], "left")
    low = lambda c: F.lower(F.col(c))
    held = F.contains(low("value"), low("needle")) | F.contains(low("needle"), low("value"))
    hit = similarity_from(F.when(held, "").otherwise(low("value")), low("needle"), F.lit(least)).isNotNull() | held  # nothing is compared where one holds the other
    return near.groupBy(by, "field").agg(F.coalesce(F.max(hit & F.col("value").isNotNull()), F.lit(False)).alias("good"))


def row_anchors(pages: DataFrame, examples: DataFrame, most_hits: int = 8, most_combos: int = 200, steps: int = 8) -> DataFrame:
    """(page_id, row, selector, item_count, n_fields, confidence, fields): the repeating block that holds an example row.

    ``examples`` has (page_id, row, field, needle). Links match anchors by their address, other fields the deepest nodes
    that hold the text; the first ``most_hits`` of each count. Of the combinations of one hit each (fields with few hits
    first, ``most_combos`` at most), that wins whose lowest common ancestor, expanded to a node with like siblings, scores
    best: many siblings, many fields, a small block; the earliest of equals. A field's selector is the nearest classed node
    from it up to the block, else its tag; none where the field is the block itself.
    """
    found = lambda tree, of: anchors.row_anchors(tree, of, most_hits, most_combos, steps)
    out = anchors.per_page(anchors.with_examples(pages, examples, "row", "field", "needle"), found, "row int, selector string, item_count long, n_fields int, reps long, fields map<string,string>", "examples")
    n = F.col("item_count")
    hundredths = 10 * F.least("n_fields", F.lit(5)) + 3 * F.least("reps", F.lit(10)) + F.when(n >= 3, 20).when(n >= 2, 10).otherwise(2)
    return out.select("page_id", "row", "selector", "item_count", "n_fields", (hundredths / 100).alias("confidence"), "fields")


def families(anchors: DataFrame) -> DataFrame:
    """(page_id, selector, item_count, confidence, fields, n_families): row_anchors() of a page brought together.

    Rows with fewer than two items go. One family of rows (with one selector) is shown by its row with most fields; several
    make a union of their selectors, of each field's distinct selectors, and the mean confidence, halves rounded up.
    """
    ok = anchors.where("item_count >= 2")
    family = ok.groupBy("page_id", "selector").agg(F.min("row").alias("first"), F.max("item_count").alias("items"), F.sum(F.round(F.col("confidence") * 100)).alias("sum"), F.count("*").alias("n_rows"), F.max_by(F.struct("fields", "confidence"), F.struct("n_fields", -F.col("row"))).alias("best"), F.array_sort(F.collect_list(F.struct("row", "fields")), lambda a, b: a["row"] - b["row"]).alias("rows"))
    page = family.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("first", "selector", "items", "best", "rows")), lambda a, b: a["first"] - b["first"]).alias("fs"), (F.floor(F.sum("sum") / F.sum("n_rows") + 0.5) / 100).alias("mean"), F.count("*").alias("n_families"))
    roles = F.array_sort(F.array_distinct(F.flatten(F.transform("fs", lambda f: F.flatten(F.transform(f["rows"], lambda r: F.map_keys(r["fields"])))))))
    first = lambda f, role: F.get(F.array_compact(F.transform(f["rows"], lambda r: F.try_element_at(r["fields"], role))), F.lit(0))
    of_role = lambda role: F.array_join(F.array_distinct(F.array_compact(F.transform("fs", lambda f: first(f, role)))), " | ")
    union = F.map_from_entries(F.transform(roles, lambda r: F.struct(r, of_role(r))))
    one = F.col("n_families") == 1
    return page.select("page_id", F.array_join(F.transform("fs", lambda f: f["selector"]), " | ").alias("selector"), F.aggregate("fs", F.lit(0).cast("long"), lambda a, f: a + f["items"]).alias("item_count"), F.when(one, F.col("fs")[0]["best"]["confidence"]).otherwise(F.col("mean")).alias("confidence"), F.when(one, F.col("fs")[0]["best"]["fields"]).otherwise(union).alias("fields"), "n_families")


def family_samples(items: DataFrame, each: int = 2, most: int = 4) -> DataFrame:
    """Samples of a union's items (page_id, family, pre, text): an item counts for its first family, two of each, four in all."""
    own = items.groupBy("page_id", "pre").agg(F.min("family").alias("family"), F.first("text").alias("text"))
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "family").orderBy("pre"))).where(F.col("k") <= each)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("family", "pre"))).where(F.col("rank") <= most).drop("k")
