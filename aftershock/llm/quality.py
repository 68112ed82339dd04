"""Quality: expected grade and tail probability by cumulative-link ordinal regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal
from .common import LOWER, prepare

#: A document is kept if its grade is above 0 with at least this probability.
KEEP = 0.5


def tokens(text: bytes) -> list[bytes]:
    """Words between white space; a word that repeats the one before it gets a mark."""
    words = text.translate(LOWER).split()
    return [b"\x00" + w if w == before else w for before, w in zip([None, *words], words)]


def features(word: bytes) -> Iterator[bytes]:
    if word[:1] == b"\x00":
        yield b"again"
        word = word[1:]
    yield b"w" + word
    yield b"e" + word[-3:]
    yield b"l%d" % min(len(word), 24)
    yield b"a" if word.isalpha() else b"d" if word.isdigit() else b"m"


TEXT = ordinal.Text(tokens, features)


def train(documents: DataFrame, labels: DataFrame, rows_per_grade: int = ordinal.ROWS_PER_GRADE) -> ordinal.Model:
    """Quality model from ``labels.quality`` (0 .. K-1; the given table has two grades)."""
    prepare(documents.sparkSession)
    return ordinal.train(documents, labels, F.col("quality"), TEXT, rows_per_grade)


def quality(documents: DataFrame, model: ordinal.Model, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, p_good and kept of every row; see ``ordinal.graded`` for odd cases. An unfitted model keeps all."""
    prepare(documents.sparkSession)
    return ordinal.graded(documents, model, TEXT).select(
        "doc_id",
        "expected_grade",
        F.col("tail")[0].alias("p_good"),
        (F.col("tail")[0] >= keep if model.fitted else F.lit(True)).alias("kept"),
    )
