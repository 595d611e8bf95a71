"""Exact integer k-means with Hamerly bounds: each vector keeps an upper bound to its own centroid and a lower one to the second nearest.

Vectors and bounds are a table of the shared folder, written anew each round. A vector whose bounds, loosened by how far
the centroids drifted, still tell its centroid apart is not compared; any other gets a full scan in exact integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, shared_dir, table

#: Components up to which 64-bit integers hold every squared distance of up to 64 components; larger ones are compared as Python integers.
SAFE = 2**27
#: Bounds are floats; each step widens them by this share, far beyond the rounding of one square root and one sum.
SLACK = 1e-12

STATE = "id long, v array<double>, cluster int, was int, upper double, lower double"


def squared(v: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances of integer-valued rows to one centroid, as integers (Python's, where 64 bits can't hold them)."""
    c = np.array(centroid, dtype=object)
    if v.shape[1] <= 64 and (not v.size or np.abs(v).max() < SAFE) and all(abs(x) < SAFE for x in centroid):
        d = v.astype(np.int64) - c.astype(np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = np.array([[int(x) for x in row] for row in v], dtype=object).reshape(v.shape) - c
    return (d * d).sum(axis=1)


def root(x: int) -> float:
    return float(x) ** 0.5


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


class Round:
    """What a round sends to its tasks: the centroids, how far each drifted, the largest drift of the others, half the gap to the next one."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None) -> None:
        k = len(centroids)
        gap = lambda a, b: root(sum((x - y) ** 2 for x, y in zip(a, b)))
        drift = [gap(a, b) * (1 + SLACK) for a, b in zip(centroids, before or centroids)]
        self.centroids, self.drift = centroids, np.array(drift)
        self.others = np.array([max([d for j, d in enumerate(drift) if j != a], default=0.0) for a in range(k)])
        self.half = np.array([min([gap(centroids[a], centroids[j]) / 2 for j in range(k) if j != a], default=np.inf) * (1 - SLACK) for a in range(k)])


def assign(now: Round, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and bounds of rows after the centroids moved; cluster -1 is none yet."""
    cluster, old = cluster.copy(), cluster >= 0
    own = np.where(old, cluster, 0)
    upper = np.where(old, (upper + now.drift[own]) * (1 + SLACK), np.inf)
    lower = np.where(old, np.maximum((lower - now.others[own]) - np.abs(lower) * SLACK, 0.0), 0.0)
    apart = np.maximum(now.half[own], lower)
    open_ = np.flatnonzero(~(upper < apart))
    for a in np.unique(cluster[open_]):  # the exact distance to a row's own centroid may settle it
        if a >= 0:
            rows = open_[cluster[open_] == a]
            upper[rows] = roots(squared(v[rows], now.centroids[a])) * (1 + SLACK)
    open_ = open_[~(upper[open_] < apart[open_])]
    if len(open_):
        d = np.stack([squared(v[open_], c) for c in now.centroids], axis=1)
        best = d.argmin(axis=1)  # the first of equals, so the smaller number
        at = np.arange(len(open_))
        upper[open_] = roots(d[at, best]) * (1 + SLACK)
        if d.shape[1] > 1:
            rest = d.astype(object) if d.dtype == object else d.copy()
            rest[at, best] = d.max() + 1
            lower[open_] = roots(rest.min(axis=1)) * (1 - SLACK)
        else:
            lower[open_] = np.inf
        cluster[open_] = best
    return cluster, upper, lower


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dims)


def next_state(state: DataFrame, now: Round, dims: int) -> DataFrame:
    """The table of vectors with their cluster among now's centroids, the one before, and both bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 4_000):
            col = b.schema.names.index
            was = np.asarray(b.column(col("cluster")).fill_null(-1))
            cluster, upper, lower = assign(now, matrix(b.column(col("v")), dims), was, np.asarray(b.column(col("upper"))), np.asarray(b.column(col("lower"))))
            yield pa.RecordBatch.from_arrays(
                [b.column(col("id")), b.column(col("v")), pa.array(cluster, pa.int32()), b.column(col("cluster")), pa.array(upper), pa.array(lower)],
                names=["id", "v", "cluster", "was", "upper", "lower"],
            )

    return state.mapInArrow(run, STATE)


def moves(state: DataFrame, dims: int) -> list:
    """For each cluster, how its number of vectors and its component sums changed in the round; only moved vectors are read."""
    moved = state.where("not (cluster <=> was)")
    signed = moved.select("v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))).alias("x")).where("x.c is not null")
    sums = [F.sum((F.col("x.s") * F.col("v")[j]).cast("decimal(28,0)")).alias(f"s{j}") for j in range(dims)]
    return signed.groupBy("x.c").agg(F.sum("x.s").alias("n"), *sums).collect()  # as many rows as centroids


def drop_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3") -> DataFrame:
    """One row per vector of ``dims`` finite components: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). The first centroids are the k vectors whose sha256 of ``seed:id`` is smallest; in
    each round every vector goes to the nearest one (of equals, the smaller number), and each centroid that has vectors
    becomes the floor of their mean. Bounds only save comparisons: all that decides is compared as integers. When a round
    moves no vector the rest would change nothing and is skipped.

    A round reads one table and writes the next, whose predecessor is then deleted, so a lost executor repeats one round
    at most; only k sums reach the driver. Vectors of another length, null, or with a null, NaN or infinite component are
    left out. Null ids are kept and come last for the first centroids; repeated rows count as often as they stand. With
    fewer than k vectors there are as many centroids. Distances that no long holds are null. No vectors give no rows.
    """
    spark = vectors.sparkSession
    ints = F.transform(F.col(vec_col), lambda x: x.cast("double") * scale)
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), ints.alias("v")).where(F.size("v") == dims).where(usable)
    floored = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))  # beyond, doubles are whole numbers
    state = kept.select("id", floored.alias("v"))
    folder = f"{shared_dir(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}"
    none = [F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("int").alias("was"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")]
    state.select("*", *none).write.option("compression", "zstd").parquet(f"{folder}/0")
    state = spark.read.parquet(f"{folder}/0")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.select("id", "v").orderBy(rank.asc_nulls_last(), "id", "v").limit(k).collect()
    centroids, before = [[int(x) for x in r["v"]] for r in first], None
    if not centroids:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    count, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    for r in range(rounds + 1):
        next_state(state, Round(centroids, before), dims).write.option("compression", "zstd").parquet(f"{folder}/{r + 1}")
        drop_table(spark, f"{folder}/{r}")
        state = spark.read.parquet(f"{folder}/{r + 1}")
        if r == rounds:
            break
        moved = moves(state, dims)
        for m in moved:
            count[m["c"]] += m["n"]
            sums[m["c"]] = [x + int(m[f"s{j}"]) for j, x in enumerate(sums[m["c"]])]
        before, centroids = centroids, [[x // n for x in s] if n else c for c, n, s in zip(centroids, count, sums)]
        if not moved:
            break
    return measured(state, centroids, dims).withColumnRenamed("id", id_col)


def measured(state: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """Exact distances of assigned vectors, and what a cluster's and all distances come to."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 4_000):
            v, cluster = matrix(b.column(1), dims), np.asarray(b.column(2))
            far = np.empty(len(v), dtype=object)
            for a in np.unique(cluster):
                far[cluster == a] = squared(v[cluster == a], centroids[a])
            far = [int(x) if x < 2**63 else None for x in far]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(far, pa.int64()), pa.array([digests[a] for a in cluster], pa.string())], names=["id", "cluster", "distance", "centroid_sha256"])

    each = state.select("id", "v", "cluster").mapInArrow(run, "id long, cluster int, distance long, centroid_sha256 string")
    totals = {r["cluster"]: int(r["s"]) for r in each.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).where("s is not null").collect()}  # k rows
    fits = lambda x: x if x is not None and x < 2**63 else None
    rows = [(a, fits(totals.get(a)), fits(sum(totals.values()))) for a in range(len(centroids))]
    cells = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long")
    return each.join(F.broadcast(cells), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 8, rounds: int = 10) -> str:
    parts_ = [
        """x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT CAST(r - 1 AS INTEGER) AS k, v AS c FROM x WHERE r <= {k})",
    ]
    for r in range(rounds + 1):
        parts_.append(f"""a{r} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (SELECT x.r, k,
  list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x, c{r}) GROUP BY r)""")
        if r < rounds:
            parts_.append(f"""m{r} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
  SELECT k, j, sum(e) AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(range(64)) AS j, unnest(v) AS e FROM x JOIN a{r} USING (r)) GROUP BY k, j) GROUP BY k)""")
            parts_.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    return "WITH " + ",\n".join(parts_) + f"""
SELECT vec_id, best.k AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM x JOIN a{rounds} USING (r) JOIN c{rounds} ON k = best.k
"""


ORACLE = _oracle()
