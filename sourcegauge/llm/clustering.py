"""Clustering around centroids with a tournament of bisectors.

For each pair of centroids the hyperplane half-way between them is kept as a normal and a threshold, both whole numbers. On
which side a vector lies is the sign of one inner product, without any distance. A vector meets the centroids one after
another: the winner so far against the next, k - 1 tests in all; a zero means equal distance and favours the
smaller number. Only the last winner's distance is computed.

Rows are read from a written table in each round; a task gives one row of sums and a count for each centroid and batch, which
are added up by Spark. What comes to the driver is one row of sums for each centroid, so neither a huge cluster nor equal vectors
gather anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from .vectors import lists_of, matrix, usable, whole

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = "1"
LONGEST = 2**63 - 1


class Bisectors:
    """Normals and thresholds of all ordered pairs: row x stays with i against j if normal[i, j] · x >= threshold[i, j]."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, np.int64)
        squares = (c * c).sum(axis=1)
        self.centroids = c
        self.normal = 2 * (c[:, None, :] - c[None, :, :])
        self.threshold = squares[:, None] - squares[None, :]

    def winners(self, x: np.ndarray) -> np.ndarray:
        won = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", x, self.normal[won, j])
            won[side < self.threshold[won, j]] = j
        return won

    def distances(self, x: np.ndarray, won: np.ndarray) -> np.ndarray:
        d = x - self.centroids[won]
        return np.einsum("nd,nd->n", d, d)


def _sums(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Bisectors(centroids)
        for batch in batches:
            x = matrix(batch.column("v"))
            if not len(x):
                continue
            won = field.winners(x)
            by = np.argsort(won, kind="stable")
            clusters, first, n = np.unique(won[by], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(clusters, pa.int32()), pa.array(n), lists_of(np.add.reduceat(x[by], first, axis=0), pa.int64())], ["cluster", "n", "sums"])

    return run


def _assign(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Bisectors(centroids)
        for batch in batches:
            x = matrix(batch.column("v"))
            if not len(x):
                continue
            won = field.winners(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(won, pa.int32()), pa.array(field.distances(x, won))], ["vec_id", "cluster", "distance"])

    return run


def _by_cluster(values: dict[int, int | str], kind: str) -> Column:
    """A value for each cluster as a literal list; there are no more than centroids."""
    return F.element_at(F.array(*[F.lit(values.get(i)).cast(kind) for i in range(max(values) + 1)]), F.col("cluster") + 1)


def _capped(total: Column) -> Column:
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row of ``vectors`` (vec_id, embedding, any others).

    Kept are vectors of exactly ``dimensions`` components, none null, NaN or infinite; they count as floor(scale * x), held within ±2**27. The
    first centroids are those with the smallest SHA-256 of ``seed:vec_id``; equal ids go by their components, null ids come last, and with fewer
    rows than centroids there are as many centroids as rows. Each round assigns rows to the nearest centroid (squared distance, ties to
    the smaller number) and moves each centroid to the floor of its rows' mean; one without rows stays. Inertia above the largest long is given as that.
    Repeated rows count each time. Other columns are not read. A table without kept rows gives an empty result.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable() & (F.size("embedding") == dimensions)).select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding", scale).alias("v"))
    kept = freeze(kept, "cluster-rows")
    hashed = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256)
    where = [list(r.v) for r in kept.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(centroids).collect()]
    if not where:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        parts = kept.mapInArrow(_sums(where), "cluster int, n long, sums array<long>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dimensions)])
        for r in sums.collect():  # one row for each centroid
            where[r.cluster] = [r[f"s{d}"] // r.n for d in range(dimensions)]
    assigned = freeze(kept.mapInArrow(_assign(where), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(where)}
    return assigned.select(
        "vec_id", "cluster", "distance", _capped(_by_cluster(inertia, "decimal(38,0)")).alias("cluster_inertia"),
        _capped(F.lit(sum(inertia.values())).cast("decimal(38,0)")).alias("inertia"), _by_cluster(names, "string").alias("centroid_sha256"))
