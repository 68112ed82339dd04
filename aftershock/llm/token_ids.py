"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those ids
that have one, and so on. A bitmap per level marks the ids that go on, a directory of ranks counts the marks before each
64-bit word of the bitmap. Token ``i`` is read by one look at each level: the rank of its mark is its place on the next.

The files are Parquet: one row per segment of whole documents, payloads as binary columns, so that Spark's own
writer commits them on any store and a reader opens only the segments it needs. Segments ascend by doc_id. A second
table, the directory, has the number of ids before each segment.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import prepare
from ..session import stage_path

#: Ids that close a segment; a longer document has a segment of its own.
SEGMENT_IDS = 32_768
#: Id appended to each document.
END_ID = 2
#: Bytes of text that are encoded together, beside a batch's last rows.
GATHERED_BYTES = 4_000_000
_FILES = "partition int, segment int, n_ids long, doc_ids array<long>, ends array<long>, chunks array<binary>, marks array<binary>, ranks array<binary>"


# --- codes


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of each level."""
    chunks, marks, ranks = [], [], []
    rest = np.asarray(ids, np.uint32)
    while True:
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        padded = np.zeros(-(-len(rest) // 64) * 64, np.uint8)
        padded[: len(rest)] = more
        marks.append(np.packbits(padded, bitorder="little").tobytes())
        sums = padded.reshape(-1, 64).sum(axis=1, dtype=np.uint32)
        ranks.append((np.cumsum(sums, dtype=np.uint32) - sums).astype("<u4").tobytes())
        if not more.any():
            return chunks, marks, ranks
        rest = rest[more] >> 8


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, chunks: list[bytes], marks: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.marks = [np.frombuffer(m, "<u8") for m in marks]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, chunk in enumerate(self.chunks):
            value |= int(chunk[i]) << (8 * level)
            word, bit = int(self.marks[level][i >> 6]), i & 63
            if not word >> bit & 1:
                return value
            i = int(self.ranks[level][i >> 6]) + (word & ((1 << bit) - 1)).bit_count()
        raise ValueError("the last level goes on")

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` on to before ``end``, from those places of each level alone."""
        out = np.zeros(end - start, np.uint32)
        at = np.arange(end - start)
        for level, chunk in enumerate(self.chunks):
            out[at] |= chunk[start:end].astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.chunks) or start == end:
                break
            first, last = start >> 6, -(-end // 64)
            bits = np.unpackbits(self.marks[level][first:last].view(np.uint8), bitorder="little")
            going = bits[start - 64 * first : end - 64 * first].astype(bool)
            start = int(self.ranks[level][first]) + int(bits[: start - 64 * first].sum())
            end = start + int(going.sum())
            at = at[going]
        return out


# --- files

_ARROW = pa.schema(
    [
        ("partition", pa.int32()),
        ("segment", pa.int32()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("chunks", pa.list_(pa.binary())),
        ("marks", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary())),
    ]
)


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a size: the more texts, the fewer distinct words each."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.nbytes for b in waiting) >= GATHERED_BYTES:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _segments(path: str, end_id: int, segment_ids: int, encode_special_tokens: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, encode_special_tokens)
        number, partition, total = 0, 0, 0
        docs: list = []
        parts: list[np.ndarray] = []
        ends: list[int] = []

        def close() -> pa.RecordBatch:
            chunks, marks, ranks = encode(np.concatenate(parts))
            values = [partition, number, total, list(docs), list(ends), chunks, marks, ranks]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)

        for batch in gathered(batches):
            partition = batch.column("partition")[0].as_py()
            ids, stops = tokenizer.encode(batch.column("text"), end_id)
            begin = 0
            for doc, stop in zip(batch.column("doc_id").to_pylist(), stops.tolist()):
                parts.append(ids[begin:stop])
                total += stop - begin
                begin = stop
                docs.append(doc)
                ends.append(total)
                if total >= segment_ids:
                    yield close()
                    number, total, docs, parts, ends = number + 1, 0, [], [], []
        if docs:
            yield close()

    return write


def write_token_ids(
    documents: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
    encode_special_tokens: bool = False,
) -> None:
    """Write the ids of every whole text, with ``end_id`` after each document, in ascending order of doc_id.

    ``path/segments`` gets the codes, ``path/directory`` the number of ids before each segment. Null texts are empty
    (one id, the end). A null doc_id comes first; rows that share a doc_id are each written, ordered by their text's hash.
    No rows make no segments. Other columns are ignored. The string of an added token in a text is that token, as the library
    has it, unless ``encode_special_tokens`` is set.
    """
    prepare(documents.sparkSession)
    ordered = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("tie")
    )
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = ordered.select("doc_id", "text", F.spark_partition_id().alias("partition"))
    rows.mapInArrow(_segments(tokenizer_path, end_id, segment_ids, encode_special_tokens), _FILES).write.option(
        "compression", "none"
    ).parquet(f"{path}/segments")
    spark = documents.sparkSession
    counts = spark.read.schema(_FILES).parquet(f"{path}/segments").select("partition", "segment", "n_ids")
    # sums per partition first: the only unpartitioned window has one row per partition
    within = Window.partitionBy("partition").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy("partition").agg(F.sum("n_ids").alias("n")).select(
        "partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    counts.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(bases, "partition").select(
        "partition", "segment", "n_ids", (F.col("base") + F.col("inside")).alias("start")
    ).write.parquet(f"{path}/directory")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("partition", "segment", "doc_id", "inside", "n_tokens", "ids_crc32")}
            for partition, segment, ids, ends, *levels in zip(
                *(batch.column(c).to_pylist() for c in ("partition", "segment", "doc_ids", "ends", "chunks", "marks", "ranks"))
            ):
                values = Segment(*levels).slice(0, ends[-1]).astype("<u4")
                out["partition"] += [partition] * len(ids)
                out["segment"] += [segment] * len(ids)
                out["doc_id"] += ids
                out["inside"] += [0, *ends[:-1]]
                for a, b in zip([0, *ends], ends):
                    out["n_tokens"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(values[a:b]))
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    codes = spark.read.schema(_FILES).parquet(f"{path}/segments")
    directory = spark.read.schema("partition int, segment int, n_ids long, start long").parquet(f"{path}/directory")
    found = codes.mapInArrow(
        read, "partition int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return found.join(directory, ["partition", "segment"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_ids(documents: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the ids of ``documents`` to ``path`` (a new shared folder if none is given) and read them back."""
    spark = documents.sparkSession
    path = path or stage_path(spark, "token-ids")
    write_token_ids(documents, tokenizer_path, path, **options)
    return read_token_ids(spark, path)


if sys.byteorder != "little":
    raise ImportError("packed ids are read as little-endian numbers")
