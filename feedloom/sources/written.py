"""Intermediate tables in the folder that driver and executors share, and large ones that no join may broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, on a local master where it is unset, a fresh folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_to.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="feedloom-checkpoint-"))
            set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_to.get()
    return found.rstrip("/")


def large(df: DataFrame) -> DataFrame:
    """df, joined by sorting and never by a broadcast. Plans know pages and what is parsed from them by compressed sizes or by guesses;
    repeated markup makes these a tenth of the real ones or less, so the driver would collect tables of hundreds of megabytes."""
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read again: several steps use it, its lineage ends there, and a lost executor costs no earlier step. No join broadcasts it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return large(df.sparkSession.read.schema(df.schema).parquet(path))
