"""Cumulative-link ordinal regression on hashed text features.

P(grade <= k) = sigmoid(threshold_k - score): one weight vector for all grades, thresholds in ascending order. A document's
score is the sum of its words' weights over the square root of their number, so that scoring takes one look-up per word;
a word's weight is the sum of the weights of its hashed features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memory, binary_texts

DIMENSIONS = 1 << 18
#: Labelled rows of each grade that a model is fitted on, at most (those with the smallest hashes of their ids).
ROWS_PER_GRADE = 1500
#: Grades in the labels, at most.
MOST_GRADES = 64
STEPS = 150
PENALTY = 2e-4

Tokens = Callable[[bytes], list[bytes]]
Features = Callable[[bytes], Iterable[bytes]]


@dataclass(frozen=True)
class Text:
    """How a text becomes words, and a word features. Functions of a module, so that workers can import them."""

    tokens: Tokens
    features: Features

    def indices(self, word: bytes) -> np.ndarray:
        return np.fromiter(
            (xxhash.xxh3_64_intdigest(f) % DIMENSIONS for f in self.features(word)), np.int64
        )


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def fitted(self) -> bool:
        return bool(np.isfinite(self.thresholds).all())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        inner = 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))
        return np.where(np.isposinf(self.thresholds)[None, :], 0.0, inner)


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, steps: int = STEPS) -> Model:
    """Fit by Adam steps over all rows. Grades are 0 .. K-1; each grade weighs the same in total.

    The thresholds are a first one plus positive gaps, so that they stay in order.
    """
    n, levels = len(grades), max(2, int(grades.max(initial=0)) + 1)
    used, local = np.unique(columns, return_inverse=True)
    weight = np.zeros(len(used))
    first, gaps = np.zeros(1), np.zeros(levels - 2)
    share = np.bincount(grades, minlength=levels).astype(float)
    of_row = (1.0 / np.maximum(share, 1))[grades] / max(1, (share > 0).sum())
    states = [[np.zeros_like(p), np.zeros_like(p)] for p in (weight, first, gaps)]
    for step in range(1, steps + 1):
        score = np.bincount(rows, weights=values * weight[local], minlength=n)
        thresholds = np.concatenate((first, first + np.cumsum(np.exp(gaps))))
        inner = 1.0 / (1.0 + np.exp(np.clip(score[:, None] - thresholds[None, :], -60, 60)))
        below = np.concatenate((np.zeros((n, 1)), inner, np.ones((n, 1))), axis=1)
        slope = np.concatenate((np.zeros((n, 1)), inner * (1 - inner), np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        chance = np.maximum(below[at, grades + 1] - below[at, grades], 1e-9)
        upper, lower = slope[at, grades + 1] / chance, slope[at, grades] / chance
        by_score = (upper - lower) * of_row  # of the negative log-likelihood
        by_threshold = np.zeros(levels - 1)
        np.add.at(by_threshold, np.minimum(grades, levels - 2), -(upper * of_row) * (grades < levels - 1))
        np.add.at(by_threshold, np.maximum(grades - 1, 0), (lower * of_row) * (grades > 0))
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradients = (
            np.bincount(local, weights=values * by_score[rows], minlength=len(used)) + PENALTY * weight,
            tail[:1],
            tail[1:] * np.exp(gaps),
        )
        for parameter, gradient, state in zip((weight, first, gaps), gradients, states):
            state[0] = 0.9 * state[0] + 0.1 * gradient
            state[1] = 0.999 * state[1] + 0.001 * gradient**2
            parameter -= 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = weight
    return Model(weights, np.concatenate((first, first + np.cumsum(np.exp(gaps)))))


def sparse(texts: list[bytes | None], text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the features of texts."""
    rows, columns, values = [], [], []
    memory = Memory()
    for i, content in enumerate(texts):
        counted = Counter(text.tokens(content or b""))
        total = sum(counted.values())
        sums: dict[int, float] = {}
        for word, times in counted.items():
            found = memory.known.get(word)
            if found is None:
                found = text.indices(word)
                memory.keep(word, found)
            for column in found.tolist():
                sums[column] = sums.get(column, 0.0) + times
        rows.append(np.full(len(sums), i, np.int32))
        columns.append(np.fromiter(sums.keys(), np.int32, len(sums)))
        values.append(np.fromiter(sums.values(), np.float32, len(sums)) / np.float32(max(total, 1) ** 0.5))
    empty = [np.empty(0, np.int32)]
    return np.concatenate(rows or empty), np.concatenate(columns or empty), np.concatenate(values or [np.empty(0, np.float32)])


def unfitted() -> Model:
    """A model by which no grade is above 0."""
    return Model(np.zeros(DIMENSIONS, np.float32), np.full(1, np.inf))


def train(documents: DataFrame, labels: DataFrame, grade: Column, text: Text, rows_per_grade: int = ROWS_PER_GRADE) -> Model:
    """Fit a model on a bounded sample of labelled rows, in one task; only the weights come to the driver.

    Labels without a document, text or grade take no part, repeated labels of a document count once (their highest
    grade). Without labelled rows of two grades nothing can be told apart: all weights are 0 and the threshold is infinite,
    so that P(grade > 0) is 0 for every text. More than ``MOST_GRADES`` grades are an error.
    """
    graded = labels.select(F.col("doc_id"), grade.cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    graded = graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    order = F.xxhash64("doc_id")
    # candidates are cut down by hash before texts are joined to them: thrice as many, as some have no document
    kept = None
    levels = [r["grade"] for r in graded.groupBy("grade").count().orderBy("grade").limit(MOST_GRADES + 1).collect()]
    if len(levels) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} grades in the labels")
    for level in levels:
        some = graded.where(F.col("grade") == level).orderBy(order, "doc_id").limit(3 * rows_per_grade)
        kept = some if kept is None else kept.unionByName(some)
    if kept is None:
        return unfitted()
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    sample = texts.join(F.broadcast(kept), "doc_id")
    best = None
    for level in levels:
        some = sample.where(F.col("grade") == level).orderBy(order, "doc_id").limit(rows_per_grade)
        best = some if best is None else best.unionByName(some)

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            rows = pa.Table.from_batches(found).sort_by([("grade", "ascending"), ("doc_id", "ascending")])
            grades = rows.column("grade").to_numpy().astype(np.int64)
            if len(np.unique(grades)) < 2:
                return
            model = fit(*sparse(binary_texts(rows.column("text")), text), grades)
            yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tolist()]})

    made = best.repartition(1).mapInArrow(run, "weights binary, thresholds array<double>").collect()
    if not made:
        return unfitted()
    return Model(np.frombuffer(bytes(made[0]["weights"]), np.float32), np.array(made[0]["thresholds"]))


class Scorer:
    """Scores of texts in a worker, with remembered words."""

    def __init__(self, model: Model, text: Text, remembered: int = Memory.BYTES):
        self.model, self.text, self.memory = model, text, Memory(remembered)

    def _weight(self, word: bytes) -> float:
        value = float(self.model.weights[self.text.indices(word)].sum())
        self.memory.keep(word, value)
        return value

    def score(self, content: bytes | None) -> float:
        words = self.text.tokens(content) if content else []
        if not words:
            return 0.0
        found = [*map(self.memory.fresh().get, words)]
        if None in found:
            found = [self._weight(w) if v is None else v for w, v in zip(words, found)]
        return sum(found) / len(words) ** 0.5


def tails(model: Model, scores: list[float]) -> np.ndarray:
    return model.tails(np.array(scores, float))


def graded(documents: DataFrame, model: Model, text: Text) -> DataFrame:
    """doc_id, expected_grade and tail (P(grade > 0), P(grade > 1), ...) of every row.

    A text without words, null included, has score 0. Repeated rows are each graded, no rows give no rows; other columns are
    ignored. Texts of any length are graded whole, each as a list of its words.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value, text)
        for batch in batches:
            chances = tails(scorer.model, [scorer.score(t) for t in binary_texts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(chances.sum(axis=1), pa.float64()),
                    pa.array(chances.tolist(), pa.list_(pa.float64())),
                ],
                names=["doc_id", "expected_grade", "tail"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail array<double>")


def filtered(documents: DataFrame, model: Model, text: Text, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of ``documents``, all columns, whose tail probabilities ``keep`` accepts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value, text)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            accepted = keep(tails(scorer.model, [scorer.score(t) for t in binary_texts(batch.column(at))]))
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
