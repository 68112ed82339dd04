"""Centroid clustering with an equal-average equal-variance search for the nearest centroid.

Centroids are sorted by the mean of their components. From the place of a vector's own mean the search goes outward on both
sides. With k components, k (m - m')^2 + (V - V')^2 is never more than the squared distance, where m is the mean and V the
root of the summed squared deviations from it: by the means alone a whole side is done with, by both a single
centroid is rejected. What is left is compared in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

CENTROIDS = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
SEED = 2
#: Scaled components reach no further, so that the squared distance of 64 components fits a long.
LARGEST = 1 << 27
#: Share by which bounds in floating point are lowered, far more than their error.
SLACK = 1e-9


def scaled(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``: components times ``scale``, rounded down, of the vectors that have ``components`` finite ones.

    Vectors that are null, of another length, or hold null, NaN or an infinity are left out. A scaled component beyond 2**27
    raises, as its distances would fit no long.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.coalesce(F.size("embedding") == components, F.lit(False))).where(finite)
    too_large = F.raise_error(F.lit("a scaled component is beyond 2**27"))
    whole = F.transform(
        "embedding",
        lambda x: F.when(F.abs(x.cast("double") * scale) <= LARGEST, F.floor(x.cast("double") * scale)).otherwise(too_large).cast("int"),
    )
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``count`` vectors of smallest hash of seed and id, in that order; vectors without an id come last.

    Rows that share an id follow each other by their components.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select("v", digest.alias("hash")).orderBy(F.col("hash").asc_nulls_last(), "v").limit(count)
    return np.array([row.v for row in chosen.collect()], np.int64)


class Search:
    """Nearest of a fixed set of centroids, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.numbers = np.argsort(sums, kind="stable")
        self.centroids, self.sums = centroids[self.numbers], sums[self.numbers]
        self.spreads = self._spread(self.centroids)
        #: distances computed so far
        self.computed = 0

    @staticmethod
    def _spread(vectors: np.ndarray) -> np.ndarray:
        """Root of k times the summed squared deviations from the mean."""
        return np.sqrt(vectors.shape[1] * np.square(vectors - vectors.mean(axis=1, keepdims=True)).sum(axis=1))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance of each vector."""
        n, k = vectors.shape
        last = len(self.sums) - 1
        sums, spreads = vectors.sum(axis=1), self._spread(vectors)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, len(self.sums))
        at = np.arange(n)
        while len(at):
            lo, hi, own = left[at], right[at], sums[at]
            below = np.where(lo >= 0, (own - self.sums[np.maximum(lo, 0)]).astype(float), np.inf)
            above = np.where(hi <= last, (self.sums[np.minimum(hi, last)] - own).astype(float), np.inf)
            gap = np.minimum(below, above)
            limit = k * best[at].astype(float)
            # by the means: all centroids further out on both sides are further away
            open_ = np.square(gap * (1 - SLACK)) <= limit
            at, gap, limit, lo, hi = at[open_], gap[open_], limit[open_], lo[open_], hi[open_]
            is_left = (below <= above)[open_]
            j = np.where(is_left, lo, hi)
            left[at[is_left]] -= 1
            right[at[~is_left]] += 1
            # by the deviations: this centroid is further away
            apart = np.abs(spreads[at] - self.spreads[j]) - SLACK * (spreads[at] + self.spreads[j])
            near = np.square(gap * (1 - SLACK)) + np.square(np.maximum(apart, 0)) <= limit
            some, j = at[near], j[near]
            distance = np.square(vectors[some] - self.centroids[j]).sum(axis=1)
            self.computed += len(some)
            candidate = self.numbers[j]
            better = (distance < best[some]) | ((distance == best[some]) & (candidate < number[some]))
            best[some[better]], number[some[better]] = distance[better], candidate[better]
        return number, best


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64)


def _sums(centroids: np.ndarray):
    """Per task: number and componentwise sum of the vectors nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("v"))
                number, _ = search.nearest(vectors)
                count += np.bincount(number, minlength=len(count))
                np.add.at(total, number, vectors)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"],
        )

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            if batch.num_rows:
                number, distance = search.nearest(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the componentwise mean of their vectors, rounded down; those without vectors stay.

    Each task gives one row of sums for each centroid it meets; only sums over all tasks, as many as the centroids have
    components, come to the driver.
    """
    parts = vectors.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
    sums = (
        parts.select("cluster", "n", F.posexplode("total").alias("component", "part"))
        .groupBy("cluster", "component")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    )
    out = centroids.copy()
    for row in sums.collect():
        out[row.cluster, row.component] = int(row.total) // row.n
    return out


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Clusters of the vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A row for each vector that ``scaled`` keeps, repeated ids included; a vector with a null id takes part like any other, but
    starts as a centroid only where ids run out. With fewer vectors than ``count`` all of them start. No vectors give no
    rows. Other columns are ignored. The centroids, ``count`` times ``components`` numbers, are all that is sent to the tasks.
    """
    spark = prepare(vectors.sparkSession)
    kept = staged(scaled(vectors, components, scale), "vectors")
    centroids = first_centroids(kept, count, seed)
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    found = staged(kept.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "clusters")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    everything = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    final = spark.createDataFrame(
        [(number, ",".join(map(str, c))) for number, c in enumerate(centroids.tolist())], "cluster int, listed string"
    )
    # one row per centroid
    about = final.join(inertia, "cluster").crossJoin(everything)
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("listed", 256).alias("centroid_sha256")
    )
