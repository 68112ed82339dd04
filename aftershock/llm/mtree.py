"""Exact top-k by inner product with M-trees.

Inner products become distances by one more component: with M the largest norm, v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0)
give |q' - v'|^2 = |q|^2 + M^2 - 2 q.v, a metric in which the nearest vectors have the highest scores. Vectors are dealt to
regions by their nearest pivot; every region is cut into trees of bounded size. A tree is a root page of routing vectors
with covering radii and leaf pages whose entries are sorted by their distance to the routing vector. A query visits
leaves best first; a leaf is left out if its ball, and an entry if its stored distance to the parent, rules out a score
that reaches the query's k-th best. Scores are whole numbers, computed exactly; bounds get a margin for rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, staged

SCALE = 1024
TOP = 10
#: Vectors of a tree and of a leaf (on average), pivots at most, and queries sent through all trees at a time.
TREE_ROWS = 4096
LEAF_ROWS = 48
PIVOTS = 4096
QUERY_BLOCK = 2048
#: Leaves that each query visits in its own order before the rest goes leaf by leaf.
OWN_ORDER = 3


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``id``, ``v`` (components as floor(scale * x)) of the vectors that take part."""
    odd = f"exists(`{vector_column}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return vectors.where(
        f"`{id_column}` IS NOT NULL AND `{vector_column}` IS NOT NULL AND size(`{vector_column}`) > 0 AND NOT {odd}"
    ).select(
        F.col(id_column).cast("long").alias("id"),
        F.expr(f"transform(`{vector_column}`, x -> CAST(floor({scale}D * CAST(x AS double)) AS long))").alias("v"),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _distances(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Distances between data vectors, with their additional component."""
    a, b = a.astype(float), b.astype(float)
    na, nb = (a * a).sum(1), (b * b).sum(1)
    extra = np.sqrt(np.maximum(largest - na, 0))[:, None] * np.sqrt(np.maximum(largest - nb, 0))[None, :]
    return np.sqrt(np.maximum(2 * largest - 2 * (a @ b.T) - 2 * extra, 0))


_TREE = "centres binary, radii binary, bounds binary, ids binary, vectors binary, parents binary"


def _grow(dim: int, largest: float):
    def grow(found):
        ids = found.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        column = found.column("v").combine_chunks()
        rows = _matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, dim)[order]
        ids = ids[order]
        count = -(-len(ids) // LEAF_ROWS)
        centres = rows[np.linspace(0, len(ids) - 1, count).astype(np.int64)]
        distance = _distances(rows, centres, largest)
        leaf = distance.argmin(axis=1)
        own = distance[np.arange(len(ids)), leaf]
        order = np.lexsort((own, leaf))
        sizes = np.bincount(leaf, minlength=count)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        radii = np.zeros(count)
        np.maximum.at(radii, leaf, own)
        values = (
            centres,
            radii,
            bounds.astype(np.int64),
            ids[order].astype(np.int64),
            rows[order],
            own[order],
        )
        names = ("centres", "radii", "bounds", "ids", "vectors", "parents")
        return pa.table({n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(names, values)})

    return grow


class Search:
    """Best scores of a block of queries over any number of trees."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, largest: float, top: int = TOP):
        self.ids, self.queries, self.top = ids, queries, top
        self.sum = (queries.astype(float) ** 2).sum(1) + largest
        self.margin = 1e-9 * self.sum + 1e-3
        self.best = np.full((len(ids), top), np.iinfo(np.int64).min)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.computed = 0

    def _reach(self, least: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Highest score at distances of at least ``least``."""
        return (self.sum[of] - np.maximum(least, 0) ** 2) / 2 + self.margin[of]

    def _leaf(self, of: np.ndarray, to_centre: np.ndarray, ids, rows, parents) -> None:
        # |d(q, centre) - d(entry, centre)| is at most d(q, entry): entries outside of that range score too little
        worst = self.best[of, -1].astype(float)
        wide = np.sqrt(np.maximum(self.sum[of] - 2 * (worst - self.margin[of]), 0))
        low = np.searchsorted(parents, (to_centre - wide).min() - 1e-6)
        high = np.searchsorted(parents, (to_centre + wide).max() + 1e-6, side="right")
        if low >= high:
            return
        ids = ids[low:high]
        scores = _products(self.queries[of], rows[low:high])
        self.computed += scores.size
        scores[ids[None, :] == self.ids[of][:, None]] = np.iinfo(np.int64).min
        both = np.concatenate((self.best[of], scores), axis=1)
        self.best[of] = -np.sort(-np.partition(both, both.shape[1] - self.top, axis=1)[:, -self.top :], axis=1)
        q, at = np.nonzero((scores >= self.best[of, -1][:, None]) & (scores > np.iinfo(np.int64).min))
        self.kept.append((of[q], ids[at], scores[q, at]))

    def tree(self, centres, radii, bounds, ids, rows, parents) -> None:
        everyone = np.arange(len(self.ids))
        to_centre = np.sqrt(np.maximum(self.sum[:, None] - 2.0 * _products(self.queries, centres), 0))
        reach = self._reach(to_centre - radii[None, :] - 1e-6, everyone[:, None])
        open_ = np.ones(reach.shape, bool)
        order = np.argsort(-reach, axis=1, kind="stable")
        for turn in range(min(OWN_ORDER, len(radii))):
            for leaf in np.unique(order[:, turn]):
                of = np.flatnonzero((order[:, turn] == leaf) & (reach[:, leaf] >= self.best[:, -1]))
                open_[order[:, turn] == leaf, leaf] = False
                if len(of):
                    a, b = bounds[leaf], bounds[leaf + 1]
                    self._leaf(of, to_centre[of, leaf], ids[a:b], rows[a:b], parents[a:b])
        for leaf in np.argsort(-reach.max(axis=0), kind="stable"):
            of = np.flatnonzero(open_[:, leaf] & (reach[:, leaf] >= self.best[:, -1]))
            if len(of):
                a, b = bounds[leaf], bounds[leaf + 1]
                self._leaf(of, to_centre[of, leaf], ids[a:b], rows[a:b], parents[a:b])
        self._settle()

    def _settle(self) -> None:
        """Only the best of each query stay; ties go to smaller ids."""
        if self.kept:
            q, ids, scores = (np.concatenate(x) for x in zip(*self.kept))
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            self.kept = [(q[nth < self.top], ids[nth < self.top], scores[nth < self.top])]

    def result(self) -> pa.RecordBatch:
        empty = np.empty(0, np.int64)
        q, ids, scores = self.kept[0] if self.kept else (empty, empty, empty)
        columns = [pa.array(x, pa.int64()) for x in (self.ids[q], ids, scores)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def _trees(batch: pa.RecordBatch, dim: int):
    kinds = (np.int64, np.float64, np.int64, np.int64, np.int64, np.float64)
    for values in zip(*(batch.column(n).to_pylist() for n in ("centres", "radii", "bounds", "ids", "vectors", "parents"))):
        arrays = [np.frombuffer(v, k) for v, k in zip(values, kinds)]
        arrays[0], arrays[4] = arrays[0].reshape(-1, dim), arrays[4].reshape(-1, dim)
        yield arrays


def build_index(vectors: DataFrame, dim: int, largest: float, rows: int) -> DataFrame:
    """Trees over ``id``, ``v``: one row each, of bounded size, whatever region holds most vectors."""
    wanted = max(1, min(PIVOTS, -(-rows // TREE_ROWS)))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow().column("v").combine_chunks()
    pivots = _matrix(chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) else chosen, dim)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                near = _distances(_matrix(batch.column("v"), dim), pivots, largest).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["id", "v", "region"])

    placed = staged(vectors.select("id", "v").mapInArrow(place, "id long, v array<long>, region int"), "placed")
    parts = placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "region").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return staged(dealt.groupBy("region", "part").applyInArrow(_grow(dim, largest), _TREE), "trees")


def top_products(
    vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", top: int = TOP
) -> DataFrame:
    """The ``top`` vectors of highest inner product for each query: query_id, rank (from 1), vec_id, score.

    Components are floor(1024 * x). Vectors that are null, empty or hold null or non-finite components, and rows without an
    id, take no part. A query's own id is no candidate; repeated rows of one id and vector count once; of vectors of
    different lengths the shorter end with zeros. Ties go to the smaller vec_id; fewer candidates give fewer rows; no
    vectors or no queries give none. Other columns are ignored. Queries go through all trees in blocks.
    """
    spark = prepare(vectors.sparkSession)
    rows = staged(whole_vectors(vectors, id_column, vector_column).distinct(), "vectors")
    asked = whole_vectors(queries, id_column, vector_column).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, dim, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    total = asked.count()
    if not count or not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, asked.agg(F.max(F.size("v"))).first()[0])
    trees = build_index(rows, dim, largest, count)
    blocks = -(-total // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toArrow()
        if not some.num_rows:
            continue
        column = some.column("v").combine_chunks()
        ids = some.column("id").to_numpy()
        matrix = _matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, dim)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def search(batches, shared=shared):
            run = None
            for batch in batches:
                for tree in _trees(batch, dim):
                    run = run or Search(*shared.value, largest, top)
                    run.tree(*tree)
            if run is not None:
                yield run.result()

        part = trees.mapInArrow(search, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", best, "vec_id", "score").where(F.col("rank") <= top)
