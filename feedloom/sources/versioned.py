"""Keyed stores in versions: immutable folders of rows, a manifest for each version, and the newest manifest as the pointer.

A version is written whole before its manifest appears under its number, which fails if another writer took that number
first. Readers hold the folders of the version they opened; a writer that dies leaves folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.items import keep_first
from ..operators.stores import SAFE_ID


class KeyedStore:
    """Rows by key in ``path``, dealt to ``buckets`` by a hash of the key; a change rewrites only the buckets that it touches."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """The numbers of all versions, oldest first."""
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[1:]) for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("v"))

    def _manifest(self, version: int) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        return json.loads(self.spark.read.text(f"{self.path}/versions/v{version}", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; an empty store gives no rows."""
        known = self.versions()
        number = known[-1] if version is None and known else version
        folders = sorted(self._manifest(number).values()) if number else []
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _change(self, keys: DataFrame, merged: Callable[[DataFrame], DataFrame], tries: int, before_commit: Callable[[], None] | None) -> int:
        """Writes the buckets of keys anew, as merged() makes them of their present rows; begins again where another writer was first."""
        touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        for _ in range(tries):
            known = self.versions()
            base = self._manifest(known[-1]) if known else {}
            held = [base[str(b)] for b in touched if str(b) in base]
            old = self.spark.read.schema(self.schema).parquet(*held) if held else self.spark.createDataFrame([], self.schema)
            folder = f"{self.path}/rows/{uuid.uuid4().hex}"
            merged(old).withColumn("__bucket", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
            there = {f.getPath().getName().partition("=")[2] for f in self._fs.listStatus(self._at(folder)) if f.isDirectory()}
            new = {b: f for b, f in base.items() if int(b) not in touched} | {b: f"{folder}/__bucket={b}" for b in there if b.isdigit()}
            if before_commit:
                before_commit()
            if self._commit((known[-1] if known else 0) + 1, new):
                return (known[-1] if known else 0) + 1
        raise RuntimeError(f"{tries} other writers were faster")

    def _commit(self, version: int, manifest: dict[str, str]) -> bool:
        """Whether the manifest could be put under its number: it is written aside and renamed, which never replaces a file."""
        aside = self._at(f"{self.path}/aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._at(f"{self.path}/versions"))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._at(f"{self.path}/versions/v{version}")), none)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                self._fs.delete(aside, False)
                return False
            raise
        return True

    def upsert(self, changes: DataFrame, order: str, tries: int = 5, before_commit: Callable[[], None] | None = None) -> int:
        """The number of the new version: of each key's changes the last by ``order`` takes its row's place. Unsafe keys are left out."""
        safe = changes.where(F.col(self.key).cast("string").rlike(SAFE_ID))
        last = keep_first(safe, [self.key], [F.desc(order)]).select(*self.read_columns())
        return self._change(safe, lambda old: old.join(last, self.key, "left_anti").unionByName(last), tries, before_commit)

    def delete(self, keys: DataFrame, tries: int = 5) -> int:
        """The number of the new version, without the rows of keys."""
        return self._change(keys, lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti"), tries, None)

    def read_columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest versions, and the folders that none of the kept ones names. No writer may be under way."""
        known = self.versions()
        kept = known[-keep:]
        named = {f.rpartition("/")[0].rpartition("/")[2] for v in kept for f in self._manifest(v).values()}
        for v in known[:-keep]:
            self._fs.delete(self._at(f"{self.path}/versions/v{v}"), False)
        rows = self._at(f"{self.path}/rows")
        for f in self._fs.listStatus(rows) if self._fs.exists(rows) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)


def config_rows(configs: DataFrame) -> DataFrame:
    """Configs as they are saved: the cache key is the id."""
    return configs.withColumn("cache_key", F.col("config_id"))
