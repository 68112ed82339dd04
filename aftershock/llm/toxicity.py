"""Toxicity: expected severity by cumulative-link ordinal regression on words and beginnings of words."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal
from .common import ALPHANUMERIC, prepare

#: A document is rejected if its severity is above 0 with at least this probability.
REJECT = 0.3
#: Bytes of the beginnings of words that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case; a word that follows itself counts once, so that no filler hides what else is said."""
    words = text.decode("utf-8", "replace").lower().encode().translate(ALPHANUMERIC).split()
    return [word for before, word in zip([None, *words], words) if word != before]


def features(word: bytes) -> Iterator[bytes]:
    yield b"w" + word
    for size in BEGINNINGS:
        if len(word) >= size:
            yield b"b%d" % size + word[:size]


TEXT = ordinal.Text(tokens, features)


def train(documents: DataFrame, labels: DataFrame, rows_per_grade: int = ordinal.ROWS_PER_GRADE) -> ordinal.Model:
    """Severity model from ``labels.toxic`` (0 .. K-1; the given table has two grades)."""
    prepare(documents.sparkSession)
    return ordinal.train(documents, labels, F.col("toxic"), TEXT, rows_per_grade)


def severity(documents: DataFrame, model: ordinal.Model, reject: float = REJECT) -> DataFrame:
    """doc_id, expected_severity, p_toxic and rejected of every row; see ``ordinal.graded`` for odd cases."""
    prepare(documents.sparkSession)
    return ordinal.graded(documents, model, TEXT).select(
        "doc_id",
        F.col("expected_grade").alias("expected_severity"),
        F.col("tail")[0].alias("p_toxic"),
        (F.col("tail")[0] >= reject).alias("rejected"),
    )


def without_toxic(documents: DataFrame, model: ordinal.Model, reject: float = REJECT) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    prepare(documents.sparkSession)
    return ordinal.filtered(documents, model, TEXT, lambda tails: tails[:, 0] < reject)
