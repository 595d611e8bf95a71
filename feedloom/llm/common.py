"""Helpers shared by the corpus operators: table reading, checkpoints, joins on hot keys, dropping rows, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows up to which a set of dropped rows is broadcast (some 40 bytes each); beyond it is joined like any other table.
MOST_BROADCAST = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches cut to so many rows, so that a Python worker turns few texts at a time into objects; Spark bounds batches by bytes."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master, a fresh one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_to.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="feedloom-checkpoint-"))
            set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_to.get()
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """df written once to the shared folder; its lineage ends there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def salted_join(rows: DataFrame, totals: DataFrame, on: list[str], n: str, how: str = "inner", hot: int = 1000, salts: int = 64) -> DataFrame:
    """rows joined to totals, which has one row for each key and the number of its rows in column n.

    A key with at least 1/hot of the rows is hot; there are at most ``hot`` of them, so their list is broadcast, whatever
    the size of the tables. Rows of hot keys are dealt to ``salts`` tasks by a hash of the row, and the key's total is
    sent to each of these. Adaptive execution can't split such a join by itself, as its one side is an aggregation.
    ``totals`` is read three times: pass a written table. Null keys match nothing.
    """
    every = totals.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * hot >= every
    hot_keys = F.broadcast(totals.where(is_hot).select(*on, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int")
    dealt = rows.join(hot_keys, on, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(totals.withColumn("__salt", F.explode(copies)), [*on, "__salt"], how).drop("__salt")


def text_key(text: Column) -> Column:
    """A 128-bit key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def act_on_rows(docs: DataFrame, acts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs by the decisions in acts (__id, __text, __keep): rows of this id and text go, or of several equal ones one stays.

    ``__text`` is the text_key(); rows that acts doesn't name stay as they are. Rows are told apart by id and text together,
    so a repeated id costs no other text, and null ids are ids like any other. Where acts is small, docs are not shuffled;
    the size is counted first.
    """
    acts = checkpoint(acts)
    sizes = {r["__keep"]: r["n"] for r in acts.groupBy("__keep").agg(F.count("*").alias("n")).collect()}
    few = sum(sizes.values()) <= MOST_BROADCAST
    own = docs.withColumns({"__own_id": F.col(id_col), "__own_text": text_key(F.col(text_col))})
    joined = own.join(F.broadcast(acts) if few else acts, F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_text") == F.col("__text")), "left")
    out = joined.where("__keep is null")
    if sizes.get(True):
        out = out.union(joined.where("__keep").dropDuplicates(["__own_id", "__own_text"]))
    return out.select(*docs.columns)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (src, dst); root is the smallest node of its component.

    Alternating large-star and small-star contraction. Each round is two min-aggregations (combined before the
    shuffle) with the minimum joined back to the neighbours, those of hot nodes salted; the number of rounds grows with the logarithm of the
    longest chain. Edges are checkpointed each round and nothing but two numbers reaches the driver.
    Nulls and self-loops are ignored; no edges give no rows.
    """
    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    edges, seen = checkpoint(edges), None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree")))
        large = salted_join(both, low, ["u"], "degree").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpoint(large)
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")))
        joined = salted_join(large, low, ["u"], "degree")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def materialise(df: DataFrame) -> DataFrame:
    """df written as compressed Parquet to the shared folder and read again: for intermediate tables too large for checkpoint()."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/feedloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
