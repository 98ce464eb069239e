"""Centroid clustering of integer vectors by scalar lookup tables.

A round tabulates, for each dimension, every integer value that occurs there and every
centroid, the squared difference. The distance of a vector to a centroid is then a sum of
table entries, gathered with NumPy; no difference is formed per vector. Sums are exact
integers throughout, so results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import stored

CENTROIDS, ROUNDS, SIZE, SCALE = 40, 5, 64, 256.0

#: Largest magnitude of an integer component: 64 squared differences of two such fit 64 bits.
LARGEST = 1 << 27

#: Vectors that are gathered at once; a gather holds this many times CENTROIDS numbers.
GATHERED = 2048


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE,
                    scale: float = SCALE) -> DataFrame:
    """``(vec_id, v)``: ``floor(scale * x)`` of each component of every vector that takes part.

    Vectors that are null, have another number of components, or hold a null or non-finite
    one take no part. A component beyond ``LARGEST`` raises an error, as its squares would
    not fit the result.
    """
    own = F.col(vec_col)
    finite = F.forall(own, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.where(own.isNotNull() & (F.size(own) == size)).where(finite)

    def whole(x):
        y = F.floor(x.cast("double") * F.lit(scale))
        return F.when(F.abs(x.cast("double") * F.lit(scale)) <= LARGEST, y).otherwise(
            F.raise_error(F.concat(F.lit("component out of range: "), x.cast("string"))).cast("long"))

    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(own, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 2) -> np.ndarray:
    """The vectors with the ``k`` smallest SHA-256 of ``seed:id``; rows without an id come last, ties by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").select("v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def _matrix(col: pa.ListArray, size: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), size)


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller at a tie) and the squared distance, for each row of ``x``."""
    tables, at = [], np.empty(x.shape, dtype=np.int64)
    for d in range(x.shape[1]):
        values, at[:, d] = np.unique(x[:, d], return_inverse=True)
        tables.append((values[:, None] - centroids[None, :, d]) ** 2)
    best, far = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
    for a in range(0, len(x), GATHERED):
        own = at[a:a + GATHERED]
        total = tables[0][own[:, 0]]
        for d in range(1, x.shape[1]):
            total += tables[d][own[:, d]]
        best[a:a + GATHERED] = total.argmin(axis=1)
        far[a:a + GATHERED] = total.min(axis=1)
    return best, far


def _round_sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """Exact ``(cluster, n, sums)`` of a round; every task gives at most one row a centroid."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), centroids.shape[1])
            best, _ = nearest_centroids(x, centroids)
            n += np.bincount(best, minlength=len(n))
            order = np.argsort(best, kind="stable")
            met, starts = np.unique(best[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(x[order], starts, axis=0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(add, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("sums")[d]) for d in range(centroids.shape[1])]).alias("sums")).collect()


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS,
                    rounds: int = ROUNDS, size: int = SIZE, scale: float = SCALE, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of every vector that takes part.

    After ``rounds`` rounds of assignment and of replacing each centroid by the floor of
    its vectors' mean (a centroid without vectors stays), vectors are assigned once more.
    Fewer than ``k`` vectors make as many centroids; equal vectors may start several, of
    which the smallest number wins. Repeated rows and rows without an id are clustered like
    others; a table without fitting vectors gives no rows. The driver holds ``k`` centroids
    and their sums, and nothing else is collected or broadcast.
    """
    spark = vectors.sparkSession
    whole = stored(integer_vectors(vectors, id_col, vec_col, size, scale))
    centroids = first_centroids(whole, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        return spark.createDataFrame([], out)
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _round_sums(whole, centroids):
            moved[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far = nearest_centroids(_matrix(batch.column(1), size), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(far)], ["vec_id", "cluster", "distance"])

    assigned = stored(whole.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sorted(sums.items())]
    kind = T.StructType.fromDDL("cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # a row for each centroid: at most k
    return assigned.join(F.broadcast(spark.createDataFrame(known, kind)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

