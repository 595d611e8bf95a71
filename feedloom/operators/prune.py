"""Pruning, skeletons and class inventories of pages, on the node relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scalars import meaningful_classes, xml_escape

SKELETON_ATTRS = ["class", "id", "role", "itemprop", "data-testid"]
#: Elements whose short text stays in a skeleton, inline wrappers that inherit it, and content elements.
KEEP_TEXT, INLINE, CONTENT = "h1 h2 h3 h4 h5 h6 a time title".split(), "span strong em b i".split(), "article li section main div".split()
#: The columns of the node relation that pruning and writing read.
PRUNE_COLUMNS = ("pre", "last", "tag", "attrs", "attr_order", "own_text", "tail", "parent_tag")
VOID = "area base br col embed hr img input link meta param source track wbr".split()


def _hit(rules: dict) -> Column:
    """Does an attribute hold or begin with one of its terms ("first": the first of id and class that the element has)."""
    first = F.try_element_at(F.filter("attr_order", lambda a: a.isin("id", "class")), F.lit(1))
    out = F.lit(False)
    for name, terms in rules.items():
        value = F.coalesce(F.col("attrs")[first] if name == "first" else F.col("attrs")[name], F.lit(""))
        for t in terms["in"]:
            out = out | value.contains(t)
        for t in terms["start"]:
            out = out | value.startswith(t)
    return out


def pruned(nodes: DataFrame, keep_structure: bool = False, prose: bool = False, precision: bool = False) -> DataFrame:
    """nodes with what is left of them: "all", "text" (a wrapper without its tags), "tail" (only the text after it) or "none".

    Subtrees of noise go: script-like elements, chrome, hidden parts and comments. ``keep_structure`` keeps aside and footer;
    ``prose`` drops metadata such as bylines as well; ``precision`` drops headers. Wrapper elements go, but their text and
    children stay in their parent. Elements that were empty from the start and carry no text go. The text that follows a dropped element
    stays with its parent.
    """
    chrome = F.col("tag").isin(L.PRUNABLE) & _hit(L.CHROME) | _hit(L.HIDDEN) | F.coalesce(F.col("attrs")["aria-hidden"] == "true", F.lit(False)) | F.col("tag").isin("div", "list", "section") & _hit(L.COMMENTS)
    if prose:
        chrome = chrome | (F.col("tag").isin(L.PRUNABLE) & _hit(L.PROSE_ONLY))
    if precision:
        chrome = chrome | (F.col("tag") == "header")
    noise = L.NOISE_TAGS + ([] if keep_structure else L.STRUCTURAL_NOISE)
    judged = nodes.withColumn("__cut", F.col("tag").isin(noise) | F.coalesce(chrome, F.lit(False)))
    # a node goes if a cut node stands before it whose subtree reaches it: the farthest end of those before, in document order
    reach = F.max(F.when(F.col("__cut"), F.col("last"))).over(Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
    judged = judged.withColumn("__inside", F.coalesce(reach >= F.col("pre"), F.lit(False)))
    empty = F.col("tag").isin(L.CUT_EMPTY) & (F.col("last") == F.col("pre")) & (F.trim("own_text") == "")
    left = F.when(F.col("__inside"), "none").when(F.col("__cut") | empty, "tail").when(F.col("tag").isin(L.WRAPPER_TAGS), "text").otherwise("all")
    return judged.withColumn("left", left).drop("__cut", "__inside")


def kept_nodes(nodes: DataFrame, **how) -> DataFrame:
    """The nodes that pruned() leaves whole."""
    return pruned(nodes, **how).where("left = 'all'").drop("left")


def stripped_attrs() -> Column:
    """A node's telling attributes as they stand in its tag, addresses cut to 60 characters."""
    kept = F.filter("attr_order", lambda a: a.isin(SKELETON_ATTRS) | a.startswith("aria-") | (a == "href"))
    value = lambda a: F.when(a == "href", F.left(F.col("attrs")[a], F.lit(60))).otherwise(F.col("attrs")[a])
    return F.array_join(F.transform(kept, lambda a: F.concat(F.lit(" "), a, F.lit('="'), xml_escape(value(a)), F.lit('"'))), "")


def collapsed(text: Column) -> Column:
    """Text as the number of its words; blank text is nothing."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.when(words > 0, F.concat(F.lit("[text:"), words.cast("string"), F.lit("]"))).otherwise("")


def telling_text() -> Column:
    """Short text of headings, links, times and titles stays as it is, also within inline wrappers; other text is collapsed."""
    keep = F.col("tag").isin(KEEP_TEXT) | (F.col("tag").isin(INLINE) & F.coalesce(F.col("parent_tag").isin(KEEP_TEXT), F.lit(False)))
    text = F.trim("own_text")
    return F.when(keep & F.length(text).between(1, 140), xml_escape(text)).otherwise(collapsed(F.col("own_text")))


def html_of(nodes: DataFrame, text: Column, tail: Column, attrs: Column, by: list[str] | None = None) -> DataFrame:
    """(by, html): nodes (with ``left``) written again in document order, each as its tag, text, children, end and the text after it.

    A node's end stands after the last node of its subtree, the innermost first.
    """
    by = by or ["page_id"]
    whole, some = F.col("left") == "all", F.col("left").isin("all", "text")
    start = F.concat(F.when(whole, F.concat(F.lit("<"), "tag", attrs, F.lit(">"))).otherwise(""), F.when(some, text).otherwise(""))
    end = F.concat(F.when(whole & ~F.col("tag").isin(VOID), F.concat(F.lit("</"), "tag", F.lit(">"))).otherwise(""), F.when(F.col("left") != "none", tail).otherwise(""))
    events = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("inner"), start.alias("s")), F.struct(F.col("last").alias("at"), F.lit(1).alias("kind"), (-F.col("pre")).alias("inner"), end.alias("s")))
    rows = nodes.select(*by, F.explode(events).alias("e")).where("e.s <> ''")
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["s"]), "").alias("html"))


def skeletons(nodes: DataFrame, most: int = 12_000) -> DataFrame:
    """(page_id, skeleton): the kept elements with telling attributes and word counts in place of text."""
    n = pruned(nodes, keep_structure=True, prose=True)
    return html_of(n, telling_text(), collapsed(F.col("tail")), stripped_attrs()).select("page_id", F.left("html", F.lit(most)).alias("skeleton"))


def text_skeletons(nodes: DataFrame, most: int = 10_000) -> DataFrame:
    """(page_id, skeleton): the kept elements with telling attributes; text is collapsed only outside of content elements."""
    zones = nodes.where(F.col("tag").isin(CONTENT)).select("page_id", F.col("pre").alias("top"), F.col("last").alias("bottom"))
    n = pruned(nodes, keep_structure=True)
    reach = n.join(zones.select("page_id", F.col("top").alias("pre"), F.col("bottom")), ["page_id", "pre"], "left")
    before = F.max("bottom").over(Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
    n = reach.withColumn("within", F.coalesce(before >= F.col("pre"), F.lit(False)))
    text = lambda plain, c: F.when(F.col("within"), xml_escape(F.col(c))).otherwise(plain)
    return html_of(n, text(telling_text(), "own_text"), text(collapsed(F.col("tail")), "tail"), stripped_attrs()).select("page_id", F.left("html", F.lit(most)).alias("skeleton"))


def anchored_snippets(nodes: DataFrame, anchors: DataFrame, above: int = 4, most: int = 4_000) -> DataFrame:
    """(page_id, snippet): the markup around the deepest node that holds a text (page_id, needle), text preserved.

    The node's ancestor ``above`` levels up is written with its telling attributes; what is longer than ``most`` characters is cut around the text.
    """
    from .selectors import deepest_hits

    n = nodes.where(~F.col("tag").isin("script", "style", "noscript", "svg"))
    hit = deepest_hits(n.select("page_id", "pre", "parent", "text", "path"), anchors, ["page_id"]).groupBy("page_id").agg(F.min_by("path", "pre").alias("path"))
    root = hit.select("page_id", F.element_at("path", F.greatest(F.size("path") - above, F.lit(1))).alias("top"))
    inside = n.join(root, "page_id").where((F.col("pre") >= F.col("top")) & (F.array_contains("path", F.col("top")))).withColumn("left", F.lit("all"))
    tail = F.when(F.col("pre") == F.col("top"), "").otherwise(xml_escape(F.col("tail")))
    cut = html_of(inside, xml_escape(F.col("own_text")), tail, stripped_attrs()).join(anchors, "page_id")
    at = F.position(F.lower("needle"), F.lower("html"))
    return cut.select("page_id", F.when(F.length("html") <= most, F.col("html")).otherwise(F.substring("html", F.greatest(at - most // 2, F.lit(1)).cast("int"), F.lit(most))).alias("snippet"))


def class_inventory(nodes: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """(page_id, rank, tag, cls, n): classes that repeat, semantic elements first, then by count."""
    c = nodes.select("page_id", "tag", "pre", F.explode(F.slice(meaningful_classes(F.col("cls")), 1, 3)).alias("cls")).where("cls <> ''")
    g = c.groupBy("page_id", "tag", "cls").agg(F.count("*").alias("n"), F.min("pre").alias("first")).where(F.col("n") >= least)
    semantic = F.col("tag").isin("article", "section", "li", "main", "time", "h1", "h2", "h3", "h4").cast("int")
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(semantic), F.desc("n"), "first", "cls")))
    return g.where(F.col("rank") <= most).select("page_id", "rank", "tag", "cls", "n")
