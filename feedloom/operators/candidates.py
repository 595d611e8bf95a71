"""Repeated blocks of pages as candidate item selectors: generation, confidence, unions, merging, date anchors, LCA anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scalars import class_id_weight, clamp, is_dated, is_unlikely, meaningful_classes, tag_baseline, without_dates


#: The columns of the node relation that each operator reads.
BLOCK_COLUMNS = ("pre", "tag", "cls", "role", "parent_tag", "parent_cls")
PARSER_COLUMNS = (*BLOCK_COLUMNS, "path")
DATE_COLUMNS = ("pre", "parent", "depth", "tag", "attrs", "cls", "own_text", "tail", "text", "path")


def _signed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("cls1", F.coalesce(F.try_element_at(meaningful_classes(F.col("cls")), F.lit(1)), F.lit("")))


def item_predicate(tag: Column, cls1: Column, role: Column) -> Column:
    """The selector of a node: by class, else role, else tag alone."""
    return F.concat(F.lit("//"), tag, F.when(cls1 != "", F.concat(F.lit("[contains(@class,'"), cls1, F.lit("')]"))).when(role != "", F.concat(F.lit("[@role='"), role, F.lit("']"))).otherwise(""))


def hundredths(thousandths: Column) -> Column:
    """A confidence between 0.05 and 0.95 from whole thousandths, rounded half up."""
    return F.floor((clamp(thousandths, 50, 950) + 5) / 10) / 100


def repeated_blocks(nodes: DataFrame, most: int = 7) -> DataFrame:
    """(page_id, selector, tag, cls1, item_count, confidence, ord, rank, is_union): repeated nodes that may hold one item each.

    Groups of three or more nodes with one tag, first class and parent kind; a tag alone only if it is article. The
    confidence grows with the count and the tag's, class's and id's weight. Two candidates of similar confidence with
    different classes and 5 to 50 items together make a union, the more frequent one first, 0.05 below the better one.
    """
    first = lambda c: F.coalesce(F.try_element_at(meaningful_classes(F.col(c)), F.lit(1)), F.lit(""))
    g = nodes.where(F.col("tag").isin(L.ITEM_TAGS)).withColumn("cls1", first("cls")).withColumn("parent_sig", F.when(F.col("parent_tag").isNotNull(), F.concat_ws("|", "parent_tag", first("parent_cls"))))
    g = g.groupBy("page_id", "parent_sig", "tag", "cls1", "role").agg(F.count("*").alias("item_count"), F.min("pre").alias("ord"), F.min_by("cls", "pre").alias("cls"))
    g = g.where((F.col("item_count") >= L.MIN_REPEATS) & ((F.col("cls1") != "") | (F.col("role") != "") | (F.col("tag") == "article")))
    raw = tag_baseline(F.col("tag")) + class_id_weight(F.col("cls"), F.lit(""))
    base = F.least(300 + (F.col("item_count") - 3) * 30, F.lit(850)) + 5 * clamp(raw, -50, 50)
    g = g.withColumn("confidence", F.when(is_unlikely(F.col("cls"), F.lit(""), F.col("role")), 0.05).otherwise(hundredths(base)))
    g = g.withColumn("selector", item_predicate(F.col("tag"), F.col("cls1"), F.col("role")))
    one = g.groupBy("page_id", "selector", "tag", "cls1").agg(F.max("item_count").alias("item_count"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"))
    # a page's candidates are few (a row for each repeated class), so their pairs are formed within its row
    fields = ["selector", "tag", "cls1", "item_count", "confidence", "ord"]
    page = one.groupBy("page_id").agg(F.collect_list(F.struct(*fields, F.lit(False).alias("is_union"))).alias("cs"))
    ahead = lambda x, y: (x["item_count"] > y["item_count"]) | ((x["item_count"] == y["item_count"]) & (x["ord"] < y["ord"]))
    fit = lambda x, y: (x["cls1"] != "") & (y["cls1"] != "") & (x["confidence"] >= 0.35) & (y["confidence"] >= 0.35) & ahead(x, y) & (x["cls1"] != y["cls1"]) & (F.abs(x["confidence"] - y["confidence"]) <= 0.15 + 1e-9) & (x["item_count"] + y["item_count"]).between(5, 50)
    joined = lambda x, y: F.struct(F.concat_ws(" | ", x["selector"], y["selector"]).alias("selector"), F.lit("").alias("tag"), F.lit("").alias("cls1"), (x["item_count"] + y["item_count"]).alias("item_count"), F.greatest(F.lit(0.05), F.round(F.greatest(x["confidence"], y["confidence"]) - 0.05, 2)).alias("confidence"), x["ord"].alias("ord"), F.lit(True).alias("is_union"))
    unions = F.flatten(F.transform("cs", lambda x: F.transform(F.filter("cs", lambda y: fit(x, y)), lambda y: joined(x, y))))
    every = page.select("page_id", F.explode(F.concat("cs", unions)).alias("c")).select("page_id", "c.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "is_union", "ord", "selector"))
    return every.withColumn("rank", rank).where(F.col("rank") <= most)


def parser_candidates(nodes: DataFrame, most: int = 7) -> DataFrame:
    """(page_id, selector, item_count, confidence, ord): nodes by tag and whole class set, none within chrome, weighted like above."""
    low = nodes.where(F.col("tag").isin(L.LOW_VALUE_ANCESTORS)).select("page_id", F.col("pre").alias("above"))
    classes = F.array_sort(F.filter(F.split("cls", r"\s+"), lambda c: c != ""))
    g = nodes.where(F.col("tag").isin(L.ITEM_TAGS)).withColumn("classes", classes).where(F.size("classes") > 0)
    g = g.groupBy("page_id", "tag", "classes").agg(F.count("*").alias("item_count"), F.min("pre").alias("ord"), F.min_by("path", "pre").alias("path"), F.min_by("cls", "pre").alias("cls"), F.min_by("role", "pre").alias("role")).where(F.col("item_count") >= L.MIN_REPEATS)
    within = g.select("page_id", "ord", F.explode("path").alias("above")).join(low, ["page_id", "above"], "left_semi").select("page_id", "ord").distinct()
    g = g.join(within, ["page_id", "ord"], "left_anti").where(~is_unlikely(F.col("cls"), F.lit(""), F.col("role")))
    raw = tag_baseline(F.col("tag")) + class_id_weight(F.col("cls"), F.lit(""))
    level = 500 + 10 * clamp(raw, -50, 50) + F.least((F.col("item_count") - 3) * 30, F.lit(300))
    named = F.coalesce(F.try_element_at(meaningful_classes(F.col("cls")), F.lit(1)), F.element_at("classes", 1))
    g = g.withColumn("confidence", hundredths(level)).withColumn("selector", item_predicate(F.col("tag"), named, F.lit("")))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "ord"))
    return g.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", "selector", "item_count", "confidence", "ord")


def merge(first: DataFrame, fill: DataFrame, most: int = 5) -> DataFrame:
    """Priority candidates and, up to ``most``, others whose selector is new; sorted by confidence and cut to ``most``."""
    both = first.select("page_id", "selector", "item_count", "confidence", "ord", F.lit(0).alias("kind")).unionByName(fill.select("page_id", "selector", "item_count", "confidence", "ord", F.lit(1).alias("kind")))
    once = both.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "selector").orderBy("kind", F.desc("confidence"), "ord"))).where("k = 1")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("kind", F.desc("confidence"), "ord"))
    kept = once.withColumn("k", place).where((F.col("kind") == 0) | (F.col("k") <= most))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "kind", "ord"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).drop("k", "kind")


def date_anchors(nodes: DataFrame) -> DataFrame:
    """(page_id, selector, item_count, confidence, exemplar): the siblings that dates repeat in; the exemplar is the first of them.

    A node is dated by a time element or datetime attribute, or a date in its own text or the text after a child. From each
    dated node, the nearest node upward with three or more like siblings (parent, tag, first class) that hold dates is an
    item; the most frequent kind wins, and its siblings need a link and 20 characters beside dates.
    """
    n = _signed(nodes)
    tails = n.where(is_dated(F.col("tail"))).select("page_id", F.col("parent").alias("pre"))
    own = n.where(((F.col("tag") == "time") & F.col("attrs")["datetime"].isNotNull()) | F.col("attrs")["datetime"].isNotNull() | is_dated(F.col("own_text"))).select("page_id", "pre")
    dated = own.union(tails).distinct().join(n.select("page_id", "pre", "path"), ["page_id", "pre"])
    up = dated.select("page_id", F.col("pre").alias("dated"), F.explode("path").alias("pre"))
    holders = up.select("page_id", "pre").distinct().join(n.select("page_id", "pre", "parent", "tag", "cls1", "depth", "text"), ["page_id", "pre"]).where("parent >= 0")
    like = Window.partitionBy("page_id", "parent", "tag", "cls1")
    items = holders.withColumn("like", F.count("*").over(like)).where("like >= 3")
    nearest = up.join(items, ["page_id", "pre"]).groupBy("page_id", "dated").agg(F.max_by(F.struct("pre", "parent", "tag", "cls1"), "depth").alias("i")).select("page_id", "i.*").distinct()
    kinds = nearest.groupBy("page_id", "tag", "cls1").agg(F.count("*").alias("n"), F.min("pre").alias("first"), F.min_by("parent", "pre").alias("parent")).where("n >= 3")
    best = kinds.groupBy("page_id").agg(F.max_by(F.struct("tag", "cls1", "parent"), F.struct("n", -F.col("first"))).alias("b")).select("page_id", "b.*")
    links = n.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).select("page_id", F.explode("path").alias("pre")).distinct()
    valid = items.join(best, ["page_id", "parent", "tag", "cls1"], "left_semi").join(links, ["page_id", "pre"], "left_semi").where(F.length(F.trim(without_dates(F.col("text")))) >= 20)
    out = valid.groupBy("page_id", "tag", "cls1").agg(F.count("*").alias("item_count"), F.min("pre").alias("exemplar")).where("item_count >= 3")
    return out.select("page_id", item_predicate(F.col("tag"), F.col("cls1"), F.lit("")).alias("selector"), "item_count", F.round(F.least(F.lit(0.9), 0.55 + 0.05 * F.col("item_count")), 2).alias("confidence"), "exemplar")


def example_anchor(nodes: DataFrame, examples: DataFrame, steps: int = 8) -> DataFrame:
    """(page_id, selector, item_count, n_fields): the repeating block that holds all example texts of a page.

    ``examples`` has (page_id, field, needle). Each needle matches its deepest nodes; the lowest common ancestor of the
    first hits goes up, at most ``steps`` levels, to a node with like siblings.
    """
    n = _signed(nodes)
    hits = n.select("page_id", "pre", "path", "depth", F.lower("text").alias("t")).join(examples, "page_id").where(F.col("t").contains(F.lower("needle")))
    deepest = hits.groupBy("page_id", "field").agg(F.min_by(F.struct("pre", "path"), F.struct(-F.col("depth"), F.col("pre"))).alias("h"))
    count = deepest.groupBy("page_id").agg(F.count("*").alias("n_fields"))
    common = deepest.select("page_id", "field", F.explode("h.path").alias("pre")).groupBy("page_id", "pre").agg(F.count("*").alias("k")).join(count, "page_id").where("k = n_fields")
    like = Window.partitionBy("page_id", "parent", "tag", "cls1")
    placed = n.withColumn("like", F.count("*").over(like)).select("page_id", "pre", "depth", "tag", "cls1", "role", "like")
    line = common.join(placed, ["page_id", "pre"])
    deep = line.groupBy("page_id").agg(F.max("depth").alias("from"))
    line = line.join(deep, "page_id").where((F.col("like") >= 2) & (F.col("from") - F.col("depth") <= steps))
    best = line.groupBy("page_id", "n_fields").agg(F.max_by(F.struct("tag", "cls1", "role", "like"), "depth").alias("b"))
    return best.select("page_id", item_predicate(F.col("b.tag"), F.col("b.cls1"), F.col("b.role")).alias("selector"), F.col("b.like").alias("item_count"), "n_fields")
