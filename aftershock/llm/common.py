"""Helpers shared by the operators: reading tables, texts as byte strings, tables written between steps."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import staged  # noqa: F401  (operators take it from here)

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows per Arrow batch. Texts of documents are long, so that the default of 10,000 rows would take much memory.
ROWS_PER_BATCH = "256"

# A-Z to a-z; the separators of [^\x20\x09-\x0D]+ are those of bytes.split().
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased; everything else separates.
_LETTERS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
ALPHANUMERIC = bytes(LOWER[b] if LOWER[b] in _LETTERS else 0x20 for b in range(256))


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on: small Arrow batches, adaptive execution, and workers that find this package.

    On a cluster the package is shipped with ``--py-files`` or installed; here its folder is added to the workers' path.
    """
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (path, _ROOT)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark's own reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def binary_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """Texts of a binary or string column as bytes."""
    return (column if pa.types.is_binary(column.type) else column.cast(pa.binary())).to_pylist()


def rows_of(batches: Iterable[pa.RecordBatch], schema: pa.Schema, each) -> Iterator[pa.RecordBatch]:
    """Apply ``each(batch) -> dict of columns`` to every batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict(each(batch), schema=schema)


#: Longer words are not remembered: what stands between two spaces may be a whole text.
LONGEST_WORD = 64


class Memory:
    """Words a worker remembers with what was found for them, bounded by their bytes."""

    #: Bytes at most, and what an entry takes beside the word itself (its place in the table and its value).
    BYTES = 40_000_000
    ENTRY = 120

    def __init__(self, most: int = BYTES):
        self.most, self.held = most, 0
        self.known: dict = {}

    def fresh(self) -> dict:
        """What is remembered; nothing, if it had become too much."""
        if self.held > self.most:
            self.known, self.held = {}, 0
        return self.known

    def keep(self, word: str | bytes, value) -> None:
        """Remember a word unless it is long or there is no room left before the next ``fresh``."""
        if len(word) <= LONGEST_WORD and self.held <= self.most:
            self.known[word] = value
            self.held += sys.getsizeof(word) + self.ENTRY
