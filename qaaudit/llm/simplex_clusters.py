"""Exact k-means over whole numbers; an n-simplex projection filters the centroids that a vector is compared with.

A few pivots among the first centroids span a simplex.  The distances of a vector to the pivots, measured once, fix the
apex of the simplex that the vector forms with them: for two apexes the Euclidean distance is a lower bound of the distance
of their vectors, and the distance after one apex is mirrored at the pivots' plane is an upper bound.  A centroid whose lower
bound is above the smallest upper bound cannot be the nearest; the others are compared in exact integers.

Apexes are written once beside the vectors; each round reads them, and a task sends one sum per centroid to the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaaudit.sources.io import staged

from .vectors import lists, matrix, whole_vectors

#: A pivot has to stand off the plane of those before it by this share of the largest distance between pivots.
LEAST_ALTITUDE = 0.01
#: Bounds are floating point: squared ones are trusted to this share of the squared distances they came from.
SLACK = 1e-6
#: Vectors compared at a time.
BLOCK = 2048


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``a`` to every row of ``b`` (a few)."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


class Simplex:
    """The pivots, and their places in a space of one dimension less than there are pivots."""

    def __init__(self, points: np.ndarray, most: int) -> None:
        """Pivots are picked from ``points`` one by one, the point farthest off the plane of the earlier ones next."""
        self.pivots, self.corners = points[:1], np.zeros((1, 0))
        scale = np.sqrt(squared(points, points).max())
        while len(self.pivots) < most:
            apexes = self.apexes(points)
            far = int(apexes[:, -1].argmax())
            if apexes[far, -1] <= LEAST_ALTITUDE * scale:
                break
            self.corners = np.vstack([np.hstack([self.corners, np.zeros((len(self.corners), 1))]), apexes[far]])
            self.pivots = np.vstack([self.pivots, points[far]])

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector its place over the pivots' plane, the altitude last, from its squared distances to the pivots."""
        d = squared(vectors, self.pivots).astype(float)
        base = self.corners[1:]
        flat = np.linalg.solve(base, (((base**2).sum(1) + d[:, :1] - d[:, 1:]) / 2).T).T if len(base) else np.zeros((len(d), 0))
        return np.hstack([flat, np.sqrt(np.maximum(d[:, :1] - (flat**2).sum(1, keepdims=True), 0.0))])


def candidates(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centres may be nearest to which vector (boolean matrix), by the bounds of their apexes."""
    size, other = (apexes**2).sum(1)[:, None], (centres**2).sum(1)
    plane = size + other - 2 * apexes[:, :-1] @ centres[:, :-1].T
    mirrored = 2 * apexes[:, -1:] * centres[:, -1]
    return plane - mirrored <= (plane + mirrored).min(1, keepdims=True) + SLACK * (size + other)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid; the smaller number wins a tie."""
    cluster, distance = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int64)
    for at in range(0, len(vectors), BLOCK):
        part = slice(at, at + BLOCK)
        who, which = np.nonzero(candidates(apexes[part], centres))
        exact = np.full((len(vectors[part]), len(centroids)), np.iinfo(np.int64).max)
        exact[who, which] = ((vectors[part][who] - centroids[which]) ** 2).sum(1)
        cluster[part] = exact.argmin(1)
        distance[part] = exact.min(1)
    return cluster, distance


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<salt>:<vec_id>``, in that order; null ids last, ties by components."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()], np.int64)


def _moved(vectors: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors (action)."""
    k, dims = centroids.shape
    centres = simplex.apexes(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = matrix(batch.column(0), dims)
            if not len(v):
                continue
            own, _ = nearest(v, matrix(batch.column(1), centres.shape[1], float), centroids, centres)
            order = np.argsort(own, kind="stable")
            present, starts = np.unique(own[order], return_index=True)
            total[present] += np.add.reduceat(v[order], starts, axis=0)
            n += np.bincount(own, minlength=k)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met], pa.int64()), lists(total[met], pa.int64())], ["cluster", "n", "total"])

    partial = vectors.select("v", "apex").mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    each = partial.select("cluster", "n", F.posexplode("total").alias("place", "total"))
    found = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    moved = centroids.copy()
    for r in found:
        moved[r.cluster, r.place] = int(r.total) // r.n
    return moved


def _assigned(vectors: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    centres, dims = simplex.apexes(centroids), centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = nearest(matrix(batch.column(1), dims), matrix(batch.column(2), centres.shape[1], float), centroids, centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "v", "apex").mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint")


def _with_apexes(kept: DataFrame, simplex: Simplex, dims: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apex = simplex.apexes(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(apex, pa.float64())], ["vec_id", "v", "apex"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(measure, f"vec_id {kind}, v array<int>, apex array<double>")


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, pivots: int = 16, salt: str = "2", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every kept vector (a written table), and the final centroids.

    Vectors have ``dims`` finite components (others, and null ones, get no row) and count as floor(256 * x).  The first
    centroids are the vectors that ``first_centroids`` names, ``k`` or as many as there are; empty clusters stay where they are.
    Rows that repeat a vec_id are vectors of their own, and a null vec_id is kept.  Equal vectors share a cluster.  An empty
    table gives no rows and no centroids.  To the driver come ``k`` vectors and, each round, ``k`` sums.
    """
    spark: SparkSession = rows.sparkSession
    kept = whole_vectors(rows, dims, ["vec_id"], vector)
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), centroids.reshape(0, dims)
    simplex = Simplex(centroids, pivots)
    vectors = staged(_with_apexes(kept, simplex, dims), "simplex-vectors")
    for _ in range(rounds):
        centroids = _moved(vectors, simplex, centroids)
    return staged(_assigned(vectors, simplex, centroids), "simplex-assigned"), centroids


def digest(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors with their cluster's and the whole table's inertia and the digest of their final centroid."""
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(exact.alias("inertia")).collect()}
    whole = sum(inertia.values())
    rows = [(c, inertia.get(c, 0), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
