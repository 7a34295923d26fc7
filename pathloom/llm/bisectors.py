"""Centroid clustering of integer vectors by a tournament of perpendicular bisectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize

DIMS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 31  # a component beyond it could not have a squared distance that is a long
CHUNK = 8_192  # vectors whose tests run together
_LONG = (1 << 63) - 1


class Bisectors:
    """Nearest centroid by k - 1 sign tests.

    For centroids a < b a vector x is nearer to b where 2 (b - a) x > |b|^2 - |a|^2. Normals
    and thresholds of all pairs are integers made once; each test knocks one
    centroid out, and a zero leaves the smaller number in.
    """

    def __init__(self, centroids: list[list[int]]):
        whole = np.array(centroids, object)
        norms = (whole * whole).sum(axis=1)
        self.k, self.dims = whole.shape
        self.normals = 2 * (whole[None, :, :] - whole[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]
        self.centroids = whole
        self.reach = int(abs(whole).max())
        self._double: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _tables(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors and tables as doubles where these hold every sum exactly, else as Python integers."""
        most = max(self.reach, int(np.abs(x).max(initial=0)))
        if 8 * self.dims * most * most >= 1 << 53:
            return x.astype(object), self.normals, self.thresholds, self.centroids
        if self._double is None:
            self._double = (self.normals.astype(float), self.thresholds.astype(float), self.centroids.astype(float))
        return x.astype(float), *self._double

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row of int64 vectors."""
        return np.concatenate([self._nearest(x[at : at + CHUNK]) for at in range(0, len(x), CHUNK)]) if len(x) else np.empty(0, np.int64)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        x, normals, thresholds, _ = self._tables(x)
        best = np.zeros(len(x), np.int64)
        for other in range(1, self.k):
            normal = normals[best, other]
            side = np.einsum("ij,ij->i", x, normal) if x.dtype == float else (x * normal).sum(axis=1)
            best[side > thresholds[best, other]] = other
        return best

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> list[int | None]:
        """Exact squared distances; None where one is no long."""
        out: list[int | None] = []
        for at in range(0, len(x), CHUNK):
            part, _, _, centroids = self._tables(x[at : at + CHUNK])
            apart = part - centroids[cluster[at : at + CHUNK]]
            out += [d if d <= _LONG else None for d in map(int, (apart * apart).sum(axis=1))]
        return out


def integer_vectors(vectors: DataFrame, key: str, vec: str, dims: int, scale: int) -> DataFrame:
    """(key, v): floor(scale * x) of every vector of ``dims`` finite components."""
    x = F.col(vec).cast("array<double>")
    def odd(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) * scale >= LARGEST)

    whole = (F.size(x) == dims) & ~F.exists(x, odd)
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(
        F.col(key).cast("bigint").alias("key"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def first_centroids(kept: DataFrame, k: int) -> list[list[int]]:
    """The k vectors of smallest sha256 of `1:<key>`, ties by components; at most k rows reach the driver."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in kept.select("v", order.alias("_h")).orderBy("_h", "v").limit(k).collect()]


def moved_centroids(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Exact floor of the mean of each centroid's vectors; one without vectors stays.

    A task sums its vectors per centroid, so k rows a task are shuffled and k x dims reach the driver.
    """
    dims = len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids)
        total, count = np.zeros((bisectors.k, dims), np.int64), np.zeros(bisectors.k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            cluster = bisectors.nearest(x)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                total[c] += x[own].sum(axis=0)
                count[c] += int(own.sum())
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(count[seen]), pa.array(total[seen].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"],
        )

    part = kept.select("v").mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    exact = F.sum(F.col("x").cast("decimal(20,0)")).alias("x")
    rows = part.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), exact).collect()
    moved = [list(c) for c in centroids]
    for r in rows:
        moved[r["cluster"]][r["i"]] = int(r["x"]) // r["n"]
    return moved


def cluster_vectors(
    vectors: DataFrame, key: str = "vec_id", vec: str = "embedding",
    k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance) of every kept vector, final centroids).

    Kept are vectors of exactly ``dims`` components, none null, NaN, infinite or so large that scaled it leaves 32 bits;
    a null vector is not kept. The k kept vectors with the smallest sha256 of their key
    are the first centroids (all of them if there are fewer; a null key counts as an empty text, rows of
    one key are told apart by their components, and equal rows may all be chosen). A
    tie of distances goes to the smaller number. ``distance`` is null if it is no long. Other columns
    are not read. Without kept vectors both results are empty.

    The integer vectors are written once; every round reads them, and only sums move.
    """
    kept = materialize(integer_vectors(vectors, key, vec, dims, scale), "vectors")
    centroids = first_centroids(kept, k)
    if not centroids:
        return kept.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        centroids = moved_centroids(kept, centroids)
    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(final)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            cluster = bisectors.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(bisectors.distances(x, cluster), pa.int64())],
                names=["key", "cluster", "distance"],
            )

    return kept.mapInArrow(assign, "key bigint, cluster int, distance bigint").withColumnRenamed("key", key), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters_with_inertia(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", **sizes: int) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    An inertia is null if it is no long or one of its distances is null. The joined table has one row per centroid.
    """
    assigned, centroids = cluster_vectors(vectors, key, vec, **sizes)
    assigned = materialize(assigned, "assigned")
    totals = {
        r["cluster"]: None if r["unknown"] else int(r["total"])
        for r in assigned.groupBy("cluster").agg(
            F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("unknown")
        ).collect()
    }
    def fits(x: int | None) -> int | None:
        return x if x is not None and x <= _LONG else None

    inertia = fits(None if None in totals.values() else sum(totals.values()))
    rows = [(c, fits(totals[c]), inertia, centroid_digest(centroids[c])) for c in sorted(totals)]
    table = assigned.sparkSession.createDataFrame(rows, "_c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), F.col("cluster") == F.col("_c")).drop("_c")
