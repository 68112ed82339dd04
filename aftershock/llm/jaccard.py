"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

1. A document's set is the distinct hashes of its word n-grams. Equal sets form a class; only one row per class goes on.
2. Rows of the matrix meet in a block if they can reach the threshold at all.
   For high thresholds: sets of sizes a and b that reach it differ in at most (1 - t) / (1 + t) * (a + b) elements. Cutting
   the hash range into more slices than that leaves at least one slice in which both sets are equal, so rows that share
   no slice are never multiplied. Size classes keep the number of slices in step with the sizes.
   For lower ones slices get too small to tell texts apart. There, two sets that reach the threshold share at least k of
   their first n - ceil(t n) + k hashes. Rows that have fewer than k hashes in common with any others go; the rest meet by
   their rarest hashes.
3. Within a block the overlap counts accumulate over blocks of columns, and a pair goes as soon as its count plus what
   is left of the smaller set cannot reach the bound that the sizes demand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, binary_texts, prepare, staged
from .components import connected_components

WORDS = 3
#: Threshold in percent: linked when 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Bounds of one block of the matrix: rows, and set elements in all of them. Larger clusters are cut into blocks.
BLOCK_ROWS = 1024
BLOCK_ELEMENTS = 2_000_000
#: Columns multiplied at a time.
BLOCK_COLUMNS = 4096
#: Rows to look for in the texts that may be broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 200_000

#: From this threshold on, rows meet by slices; below, by the first hashes of their sets.
SLICES_FROM = 85

_LARGE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; one of the whole sequence if it is shorter."""
    found = text.translate(LOWER).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    span = min(words, len(found))
    mixed = np.full(len(found) - span + 1, span, np.uint64)
    for i in range(span):
        mixed = (mixed ^ hashes[i : len(found) - span + 1 + i]) * _LARGE
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@lru_cache(maxsize=8)
def size_classes(percent: int) -> tuple[int, ...]:
    """Lower bounds of the size classes: sets that reach the threshold lie in one class or in two adjacent ones."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        largest = (bounds[-1] - 1) * 100 // percent if len(bounds) > 1 else 1
        bounds.append(max(largest, bounds[-1]) + 1)
    return tuple(bounds)


def _slices(scheme: int, percent: int) -> tuple[int, int]:
    """Slices of the hash range for pairs of the classes ``scheme`` and the next, and how many light ones a set may skip.

    Slices of at most two elements are light: they would bring together sets that share a common passage. A pair
    shares at least one slice more than the set may skip, so that one that is not light remains.
    """
    bounds = size_classes(percent)
    total = (bounds[scheme + 1] - 1) + (bounds[scheme + 2] - 1)
    differ = (100 - percent) * total // (100 + percent)
    skip = 2 + differ // 64 if differ else 0
    return differ + 1 + skip, skip


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the slices by which a set can meet another one that reaches the threshold."""
    if not len(hashes):
        return hashes
    bounds = size_classes(percent)
    own = int(np.searchsorted(np.array(bounds, np.int64), len(hashes), side="right")) - 1
    parts = []
    spread = (hashes * _MIX) >> np.uint64(32)
    # a sum of mixed hashes identifies a slice's content, as the hashes are distinct
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _LARGE
    for scheme in (own, own - 1) if own else (own,):
        count, skip = _slices(scheme, percent)
        if count - skip == 1:  # no difference is allowed: equal sets only, and those are one class already
            continue
        at = ((spread * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
        filled = np.bincount(at, minlength=count)
        order = np.argsort(at, kind="stable")
        sums = np.zeros(count, np.uint64)
        heads = np.concatenate(([0], np.cumsum(filled)[:-1]))
        with_any = filled > 0
        sums[with_any] = np.add.reduceat(mixed[order], heads[with_any])
        slot = np.arange(count, dtype=np.uint64) + np.uint64(scheme) * np.uint64(1_000_003)
        made = (sums ^ (slot * _MIX)) * _LARGE
        made ^= made >> np.uint64(32)
        light = filled <= 2
        parts.append(made if light.sum() > skip else made[~light])
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _first(size: int, percent: int) -> tuple[int, int]:
    """How many of a set's first hashes are compared, and k: how many of them a similar set of its size shares."""
    free = size + -percent * size // 100 + 1
    k = max(1, 3 * free // 4)
    return min(size, free - 1 + k), k


def first_hashes(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The hashes by which a set can meet a different one that reaches the threshold."""
    size = len(hashes)
    if 100 * size < percent * (size + 1):  # only equal sets reach it
        return hashes[:0]
    return hashes[: _first(size, percent)[0]]


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    """Equal sets have equal keys."""
    key = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)


_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sigs", pa.list_(pa.int64()))]
)


def _set_rows(words: int, percent: int):
    def build(batches):
        for batch in batches:
            ids, sizes, k1, k2, flat, ends = batch.column("doc_id"), [], [], [], [], [0]
            for text in binary_texts(batch.column("text")):
                hashes = shingles(text, words)
                sizes.append(len(hashes))
                high, low = _set_key(hashes)
                k1.append(high)
                k2.append(low)
                keys = signatures(hashes, percent) if percent >= SLICES_FROM else first_hashes(hashes, percent)
                flat.append(keys.view(np.int64))
                ends.append(ends[-1] + len(flat[-1]))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], schema=_SETS
            )

    return build


def overlaps(sets: list[np.ndarray], percent: int, first: int | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that reach the threshold; with ``first``, only pairs of one before that place and one from it on.

    The product of the incidence matrix with its transpose, one block of columns at a time. ``alive`` holds the pairs
    that can still reach the bound their sizes demand.
    """
    sizes = np.array([len(s) for s in sets], np.int32)
    total = sizes[:, None] + sizes[None, :]
    need = (-(-percent * total.astype(np.int64) // (100 + percent))).astype(np.int32)  # 100 i >= p (a + b - i)
    alive = np.minimum(sizes[:, None], sizes[None, :]) >= need
    alive &= np.triu(np.ones_like(alive), 1)
    if first is not None:
        alive[:first, :first] = False
        alive[first:, first:] = False
    if not alive.any():
        return []
    columns, column, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    useful = shared[column] > 1
    left = np.bincount(rows[useful], minlength=len(sets)).astype(np.int32)
    rows, column = rows[useful], column[useful]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    counts = np.zeros(alive.shape, np.int32)
    start = 0
    place = np.cumsum(np.concatenate(([0], np.diff(column) > 0))) if len(column) else column
    while start < len(rows) and alive.any():
        end = int(np.searchsorted(place, place[start] + BLOCK_COLUMNS))
        block = np.zeros((len(sets), BLOCK_COLUMNS), np.float32)
        block[rows[start:end], place[start:end] - place[start]] = 1
        counts += (block @ block.T).astype(np.int32)
        left -= np.bincount(rows[start:end], minlength=len(sets)).astype(np.int32)
        alive &= counts + np.minimum(left[:, None], left[None, :]) >= need
        start = end
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(alive & (counts >= need)))]


def _forest(ids: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Id and smallest linked id of every row that has a link, within one block; rows with different sets may share an id."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[a if ids[a] > ids[b] else b] = a if ids[a] < ids[b] else b
    return [(ids[i], ids[root(i)]) for i in range(len(ids)) if ids[root(i)] != ids[i]]


def _multiply(percent: int):
    def block(key, found):
        left, right = key[1].as_py(), key[2].as_py()
        rows = sorted(
            zip(found.column("block").to_pylist(), found.column("doc_id").to_pylist(), found.column("items").to_pylist())
        )
        ids = [r[1] for r in rows]
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        pairs = overlaps(sets, percent, None if left == right else sum(r[0] == left for r in rows))
        links = _forest(ids, pairs)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return block


def _rarest(slots: DataFrame, percent: int) -> DataFrame:
    """Of the first hashes of each row, the rarest ones, by which it meets every row that reaches the threshold.

    With c hashes that other rows have too, of which similar rows share k, the c - k + 1 rarest suffice. A row has few
    of these hashes, and each has its own, so the windows are bounded.
    """
    smallest = F.floor((F.col("n") * percent + 99) / 100)  # of a set that can reach the threshold with this one
    k = F.greatest(F.lit(1), F.floor((smallest - F.floor((smallest * percent + 99) / 100) + 1) * 3 / 4))
    own = Window.partitionBy("b")
    met = slots.groupBy("sig").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("sig")
    shared = staged(
        slots.join(met, "sig").withColumn("k", k).withColumn("c", F.count(F.lit(1)).over(own)).where("c >= k").drop("c", "n"),
        "shared",
    )
    still = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    ranked = shared.join(still, "sig").withColumn("c", F.count(F.lit(1)).over(own)).where("c >= k")
    nth = F.row_number().over(own.orderBy("rows", "sig"))
    return ranked.withColumn("nth", nth).where("nth <= c - k + 1").select("b", "sig")


def similar_documents(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Groups of documents whose word n-gram sets reach the threshold, directly or by a chain of links.

    Returns a row for each row of ``documents``: doc_id, n_shingles (size of its set), class_id (smallest doc_id with an
    equal set), component_id (smallest doc_id reachable by links, itself included). Documents without words, null
    texts included, have n_shingles 0 and are linked with nothing. Rows with a null doc_id are returned with a null
    component; rows that share a doc_id are one node of the link graph, with the links of all their sets. Other columns are
    ignored. No text is cut, no pair is left out: sets that reach the threshold always meet in a block.
    """
    spark = prepare(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sets = staged(texts.mapInArrow(_set_rows(words, percent), "doc_id long, n long, k1 long, k2 long, sigs array<long>"), "sets")
    filled = sets.where("n > 0 and doc_id is not null")
    repeated = not filled.groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = filled.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "sigs")).alias("least"))

    # rows that share a key with another one, linked to the smallest row of the key
    slots = classes.select(F.col("least.doc_id").alias("b"), F.col("least.n").alias("n"), F.explode("least.sigs").alias("sig"))
    if percent < SLICES_FROM:
        slots = staged(_rarest(slots, percent), "slots")
    leads = slots.groupBy("sig").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    meets = staged(slots.select("b", "sig").join(leads, "sig").where("a <> b").select("a", "b").distinct(), "meets")
    clusters = staged(connected_components(meets), "clusters")

    # clusters in blocks of bounded size
    names = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"))
    member = clusters.join(names, "node")
    whole = member.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements")).select(
        "component",
        F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int").alias("blocks"),
    )
    placed = staged(
        member.join(whole, "component").select(
            F.col("node").alias("doc_id"),
            *(("k1", "k2") if repeated else ()),
            F.col("component").alias("cluster"),
            "blocks",
            F.pmod(F.xxhash64("node", "k1", "k2"), F.col("blocks")).cast("int").alias("block"),
        ),
        "placed",
    )
    wanted = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed

    def to_sets(batches):
        for batch in batches:
            found = [shingles(t, words) for t in binary_texts(batch.column("text"))]
            keep = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            if repeated:
                keys = [_set_key(h) for h in found]
                keep |= {"k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64())}
            keep["items"] = pa.array([h.tobytes() for h in found], pa.binary())
            yield pa.RecordBatch.from_pydict(keep)

    if repeated:
        # a doc_id may have several texts: each different set of it is a row of its own
        some = texts.join(wanted.select("doc_id"), "doc_id", "left_semi")
        sets_of = some.mapInArrow(to_sets, "doc_id long, k1 long, k2 long, items binary")
        rows = sets_of.join(wanted, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).drop("k1", "k2")
    else:
        rows = texts.join(wanted, "doc_id").select("doc_id", "cluster", "blocks", "block", "text").mapInArrow(
            to_sets, "doc_id long, cluster long, blocks int, block int, items binary"
        )
    # block i meets every block j: the row goes to (i, j) for j >= i and to (j, i) for j < i
    paired = rows.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "doc_id", "cluster", "block", "items", "blocks",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    links = staged(
        paired.groupBy("cluster", "low", "high").applyInArrow(_multiply(percent), "a long, b long"), "product"
    )
    if repeated:
        # the sets of a doc_id are linked through it
        own = filled.select("doc_id", "k1", "k2").distinct().join(names, ["k1", "k2"])
        links = staged(
            links.unionByName(own.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))), "links"
        )
    component = connected_components(links).withColumnRenamed("component", "linked")

    grouped = names.join(component, "node", "left").select(
        "k1", "k2", F.col("node").alias("class_id"), F.coalesce("linked", "node").alias("linked")
    )
    # a document's key brings its class; copies may be a third of all rows, and adaptive execution splits them
    joined = sets.select("doc_id", "n", "k1", "k2").join(grouped, ["k1", "k2"], "left")
    alone = F.col("n") == 0
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("linked")).alias("component_id"),
    )


def keep_one_of_each_group(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest doc_id.

    Keeps all columns. Rows without words stay; of rows that repeat a kept doc_id one stays (the smallest text);
    rows with a null doc_id stay.
    """
    found = similar_documents(documents, words, percent)
    drop = staged(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__drop")).distinct(), "drop")
    side = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    kept = documents.join(side, F.col("doc_id") == F.col("__drop"), "left_anti")
    repeated = staged(
        found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")),
        "again",
    )
    if repeated.isEmpty():
        return kept
    same = F.col("doc_id") == F.col("__again")
    first = kept.join(repeated, same, "left_semi").withColumn(
        "__nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    )
    return kept.join(repeated, same, "left_anti").unionByName(first.where("__nth = 1").drop("__nth"))
