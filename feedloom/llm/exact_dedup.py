"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, act_on_rows, checkpoint, salted_join, table, text_key

#: Bits of the survivor bitmap for each surviving group, and its bounds: 2^20 (128 KB) to 2^28 bits (32 MB).
BITS_EACH, LEAST_LOG2, MOST_LOG2 = 16, 20, 28


def normalised(text: Column) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def marked_rows(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, most_log2: int, digest: bool = False, **more: Column) -> DataFrame:
    """One row per input row: id, full (the hash of the whole text where length and prefix leave a choice, else null), and ``more`` columns."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), *[c.alias(f"__{n}") for n, c in more.items()])
    keyed = rows.select("*", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))
    level2 = checkpoint(keyed.groupBy("len", "prefix").agg(F.count("*").alias("n")))
    level1 = level2.groupBy("len").agg(F.sum("n").alias("of_len")).where("of_len > 1")
    survivors = checkpoint(level2.where("n > 1").join(level1, "len", "left_semi").select("len", "prefix"))
    count, full = survivors.count(), F.sha2("norm", 256)
    shown = [F.col("__" + n).alias(n) for n in more] + [full.alias("text_sha256")] * digest
    log2 = max(LEAST_LOG2, (count * BITS_EACH).bit_length())
    if log2 > most_log2:  # too many groups for a bitmap that every executor holds: their narrow keys are joined
        return joined_marks(keyed, survivors, full, shown)
    slot = F.pmod(F.xxhash64("len", "prefix"), F.lit(1 << log2))
    bits = survivors.select(slot.alias("slot")).groupBy((F.col("slot") / 32768).cast("int").alias("part")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast((slot % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    survives = F.coalesce(F.expr("shiftright(byte, cast(slot % 8 as int)) & 1 = 1"), F.lit(False))
    marked = (
        keyed.withColumn("slot", slot)
        .withColumn("part", (F.col("slot") / 32768).cast("int"))
        .join(F.broadcast(bits), "part", "left")
        .withColumn("byte", byte)
        .withColumn("survives", survives)
    )
    return marked.select("id", F.when(F.col("survives"), full).alias("full"), *shown)


def joined_marks(keyed: DataFrame, survivors: DataFrame, full: Column, shown: list[Column]) -> DataFrame:
    """What marked_rows() gives, by a join of the texts with the surviving keys; both hot and large sides are plain, so skewed ones are split."""
    out = keyed.join(survivors.withColumn("survives", F.lit(True)), ["len", "prefix"], "left")
    return out.select("id", F.when(F.col("survives"), full).alias("full"), *shown)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest: bool = False, most_log2: int = MOST_LOG2) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept (and text_sha256 where digest is set).

    Texts are equal when their normalised forms are. The first pass reads length and a hash of the first
    ``prefix_chars`` characters, counted per group with partial aggregation. Groups of one length, then of one
    (length, prefix), that hold two rows or more survive. They are marked in a bitmap of sixteen bits for each, 32 MB at
    most (beyond that, keys are joined), so the second pass hashes the full content of surviving groups only, without
    shuffling any text; bits shared by chance (one in sixteen) cost a hash, never a wrong result. Copies are then grouped
    by their full SHA-256.

    Null text counts as empty. Rows that share the smallest id of their group are all marked kept (ids are expected to be
    unique; keep_first_copies leaves one of them); a null id never becomes keep_id unless the whole group has none, and
    such a group is marked kept as a whole. Extra columns are not read. An empty table gives an empty result.
    """
    marked = checkpoint(marked_rows(docs, id_col, text_col, prefix_chars, most_log2, digest))
    groups = checkpoint(marked.where("full is not null").groupBy(F.col("full").alias("key")).agg(F.min("id").alias("keep"), F.count("*").alias("n")))
    # rows without a full hash get keys of their own, so that they don't meet in one task
    single = marked.withColumn("key", F.coalesce("full", F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.uuid()))))
    out = salted_join(single, groups, ["key"], "n", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.expr("keep is null or id <=> keep").alias("kept"),
        *["text_sha256"] * digest,
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, most_log2: int = MOST_LOG2) -> DataFrame:
    """docs with one row of each group of equal texts, that with the smallest id; all columns stay.

    Of rows with the smallest id and different white space, that with the smallest hash stays; of rows with one id and
    text, any one. Null ids come last: of a group that has none but null ids, one row stays. Null text counts as empty.
    """
    marked = marked_rows(docs, id_col, text_col, prefix_chars, most_log2, text=text_key(F.col(text_col))).where("full is not null")
    keys = checkpoint(marked.groupBy("full", "id", "text").agg(F.count("*").alias("times")))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text")
    groups = checkpoint(keys.groupBy("full").agg(F.min(rank).alias("first"), F.count("*").alias("n"), F.sum("times").alias("rows")).where("rows > 1"))
    judged = salted_join(keys, groups.select("full", "first", "n"), ["full"], "n").withColumn("keep", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text") == F.col("first.text")))
    acts = judged.where("not keep or times > 1").select(F.col("id").alias("__id"), F.col("text").alias("__text"), F.col("keep").alias("__keep"))
    return act_on_rows(docs, acts, id_col, text_col)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest=True)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
