"""A corpus pipeline: toxic documents go, then exact copies, near copies and benchmark leaks; the rest is mixed to target weights.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns the kept ones with
their columns; the last adds the sampling columns. Between stages, documents are written as Parquet to the folder that
driver and executors share, so a lost executor repeats no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm.common import shared_dir, table
from feedloom.llm.decontam import drop_contaminated
from feedloom.llm.exact_dedup import keep_first_copies
from feedloom.llm.mixing import sample_mixture
from feedloom.llm.simhash import keep_one_of_each
from feedloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores as toxic go (operator 3). Rows without text score like any other; empty tables give no rows."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after white space is made uniform, one row stays (operator 7). A repeated id costs no other text."""
    return keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a five-word similarity of 0.8 or more, one row stays (operator 5's SimHash links within 3 bits, and MinHash keys beside them)."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding the question and the answer of a benchmark item go (operator 10)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to target weights of source, language and topic (operator 9), with the sampling columns."""
    return sample_mixture(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The label model and the fingerprints of the stages can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir through all stages."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
