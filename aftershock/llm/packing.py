"""Best-fit packing of tokenised documents into sequences of one capacity.

Documents longer than a sequence are cut into full pieces, but for a shorter first one. Which pieces share a sequence depends on
their lengths alone, so the packing is found on the number of pieces of each length: pieces above a third of the
capacity pair at most twice per sequence by greedy matching, the smaller ones go by best fit into the gaps that remain.
That makes a short list of steps, each of which places a range of the pieces of one length into a range of
sequences. Pieces are numbered within their length where they lie and look their places up in that list.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import prepare, staged
from .token_ids import gathered

CAPACITY = 2048
#: Id appended to each document.
END_ID = 0
#: Rows in one broadcast; beyond that the join is left to Spark.
BROADCAST_ROWS = 200_000


# --- which lengths share a sequence


@dataclass(frozen=True)
class Step:
    """Pieces ``first`` to ``first + count - 1`` of one length go ``each`` by ``each`` into sequences from ``sequence`` on, each
    time from ``offset`` on."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


class _Gaps:
    """Sequences with room left, as ranges of their numbers by the size of the gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, sequence: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in self.ranges:
                self.ranges[gap] = []
                bisect.insort(self.sizes, gap)
            self.ranges[gap].append((sequence, count))

    def smallest(self, length: int) -> int | None:
        """The smallest gap into which ``length`` fits."""
        i = bisect.bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, gap: int) -> tuple[int, int]:
        ranges = self.ranges[gap]
        found = ranges.pop()
        if not ranges:
            del self.ranges[gap]
            self.sizes.remove(gap)
        return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Steps that place ``counts`` pieces of each length into as few sequences as this method can.

    The work and the number of steps depend on the number of different lengths, not on that of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("lengths must be from 1 to the capacity")
    placed = dict.fromkeys(left, 0)
    steps: list[Step] = []
    gaps = _Gaps(capacity)
    sequences = 0

    def place(length: int, count: int, sequence: int, each: int, offset: int) -> None:
        steps.append(Step(length, placed[length], count, sequence, each, offset))
        placed[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    # the largest first, each with the largest that fits beside it
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        length = large[-1]
        i = bisect.bisect_right(large, capacity - length) - 1
        if i == len(large) - 1 and left[length] == 1:
            i -= 1  # it has no partner of its own length
        n, gap = left[length], capacity - length
        if i < 0:
            place(length, n, sequences, 1, 0)
        elif large[i] == length:
            n, gap = n // 2, gap - length
            place(length, 2 * n, sequences, 2, 0)
        else:
            n, gap = min(n, left[large[i]]), gap - large[i]
            place(length, n, sequences, 1, 0)
            place(large[i], n, sequences, 1, length)
        gaps.add(gap, sequences, n)
        sequences += n
        large = [m for m in large if m in left]

    # the smaller ones into the tightest gap, as often as they fit there
    for length in sorted(left, reverse=True):
        while length in left:
            gap = gaps.smallest(length)
            if gap is None:
                gap = capacity
                first, free = sequences, -(-left[length] // (capacity // length))
                sequences += free
            else:
                first, free = gaps.take(gap)
            each = gap // length
            full = min(free, left[length] // each)
            offset = capacity - gap
            if full:
                place(length, full * each, first, each, offset)
                gaps.add(gap - each * length, first, full)
            rest = left.get(length, 0)
            if full < free:
                part = min(rest, each)  # fewer than fill one sequence
                if part:
                    place(length, part, first + full, part, offset)
                    gaps.add(gap - part * length, first + full, 1)
                gaps.add(gap, first + full + (part > 0), free - full - (part > 0))
    return steps


# --- pieces

_PIECES = "task int, nth long, doc_id long, piece int, start long, length int, ids binary"
_ARROW = pa.schema(
    [
        ("task", pa.int32()),
        ("nth", pa.int64()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("ids", pa.binary()),
    ]
)


def _runs(values: np.ndarray, size: int) -> np.ndarray:
    """For each value, how many equal ones stand before it; values are below ``size``."""
    order = np.argsort(values, kind="stable")
    counts = np.bincount(values, minlength=size)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    return out


def _cut(path: str, end_id: int, capacity: int, encode_special_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, encode_special_tokens)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in gathered(batches):
            ids, ends = tokenizer.encode(batch.column("text"), end_id)
            sizes = np.diff(ends, prepend=0)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (sizes - (pieces - 1) * capacity)[doc]
            length = np.where(piece == 0, first, capacity)
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            nth = seen[length] + _runs(length, capacity + 1)
            seen += np.bincount(length, minlength=capacity + 1)
            bounds = np.append(0, np.cumsum(length) * ids.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(doc), batch.column("task")[0].as_py()), pa.int32()),
                    pa.array(nth),
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length, pa.int32()),
                    packed,
                ],
                schema=_ARROW,
            )

    return run


def cut_pieces(
    documents: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    encode_special_tokens: bool = False,
) -> DataFrame:
    """Pieces of all documents with their ids (two bytes each, or four beyond 65,536 different ids, little-endian).

    ``nth`` numbers the pieces of one length within their task.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("task"))
    return rows.mapInArrow(_cut(tokenizer_path, end_id, capacity, encode_special_tokens), _PIECES)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written pieces with ``sequence_id`` and ``offset``.

    Only the number of pieces of each length, one row for each length, comes to the driver.
    """
    spark = pieces.sparkSession
    counts = staged(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    steps = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    listed = spark.createDataFrame(
        [(s.length, s.first, s.first + s.count, s.sequence, s.each, s.offset) for s in steps],
        "of_length int, first long, stop long, sequence long, each int, base int",
    )
    if len(steps) <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    # numbers of a task's pieces of one length follow those of the tasks before it
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("length").alias("of_length"), F.col("task").alias("of_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    if counts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    ranked = (
        pieces.join(bases, (F.col("length") == F.col("of_length")) & (F.col("task") == F.col("of_task")))
        .withColumn("number", F.col("nth") + F.col("ahead"))
        .drop("of_length", "of_task", "ahead", "nth", "task")
    )
    inside = (F.col("length") == F.col("of_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("stop"))
    nth = F.col("number") - F.col("first")
    return ranked.join(listed, inside).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Packed sequences: sequence_id, pieces (doc_id, piece, start, length, offset, ids) in the order of their offsets.

    The pieces of a sequence stand one after another from offset 0 on; their ids put together are the sequence. Null and empty
    texts are one id, the end. A null doc_id stays null, rows that share one are cut each on their own, other columns are
    ignored. No rows give no sequences. A document of any length is cut into pieces of ``capacity`` ids, the first shorter
    where that does not come out even; nothing else is cut.
    """
    prepare(documents.sparkSession)
    pieces = staged(cut_pieces(documents, tokenizer_path, capacity, **options), "pieces")
    one = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    return placed(pieces, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("pieces"))


_DIGEST = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("pieces")
            flat = lists.flatten()
            lengths = flat.field("length").to_pylist()
            widths = {2: "<u2", 4: "<u4"}
            sums = [
                zlib.crc32(np.frombuffer(ids, widths[len(ids) // n]).astype("<u4"))
                for ids, n in zip(flat.field("ids").to_pylist(), lengths)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("doc_id"),
                    flat.field("piece"),
                    flat.field("start"),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                    batch.column("sequence_id").take(pc.list_parent_indices(lists)),
                    flat.field("offset"),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )


def digests(sequences: DataFrame) -> DataFrame:
    """One row per piece, read back from packed sequences: its place and the checksum of its ids as 32-bit numbers."""
    return sequences.mapInArrow(
        _digests, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
