"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates every vocabulary piece inside a word; dynamic programming carries the best score and
the number of pieces of each beginning of the word. Ties and unknown characters go as in the tokenizers library: of
equal scores the one with the earlier start stays, a character that no piece of one character covers may be unknown at
ten below the lowest score, and unknown characters become one token per byte if the vocabulary has all bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, prepare

SPACE = "▁"
#: What an unknown character scores below the lowest piece.
UNKNOWN = 10.0


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, and the id of the unknown one, of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Token counts of words and texts."""

    def __init__(self, pieces: Iterable[tuple[str, float]], remembered: int = Memory.BYTES):
        pieces = list(pieces)
        scores: dict[str, float] = {}
        for piece, score in pieces:
            if piece:
                scores[piece] = score
        self.lowest = min(score for _, score in pieces) - UNKNOWN
        self.singles = frozenset(p for p in scores if len(p) == 1)
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.memory = Memory(remembered)

    def word(self, word: str) -> int:
        """Tokens of one word, its leading space included."""
        size = len(word)
        best = [0.0] + [None] * size
        count = [0] * (size + 1)
        unknown = [False] * (size + 1)
        place = 0

        def close(end: int) -> None:
            """The end's unknown character comes after all pieces: it starts last."""
            char = word[end - 1]
            if char not in self.singles:
                score = best[end - 1] + self.lowest
                if best[end] is None or score > best[end]:
                    best[end], unknown[end] = score, True
                    if self.bytes:
                        count[end] = count[end - 1] + len(char.encode("utf-8", "surrogatepass"))
                    else:  # unknown characters in a row are one token
                        count[end] = count[end - 1] + (0 if unknown[end - 1] else 1)

        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            while place < last:
                place += 1
                close(place)
            start = end - length
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[start] + 1
        while place < size:
            place += 1
            close(place)
        return count[size]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; words are told apart once per batch."""
        texts = pc.replace_substring(texts.fill_null(""), SPACE, " ")
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        flat = cut.flatten().dictionary_encode()
        at = flat.indices.to_numpy(zero_copy_only=False)
        known = self.memory.fresh()
        sizes = np.zeros(len(flat.dictionary), np.int64)
        for i, piece in enumerate(flat.dictionary.to_pylist()):
            found = known.get(piece)
            if found is None:
                found = self.word(SPACE + piece)
                self.memory.keep(piece, found)
            sizes[i] = found
        each = sizes[at]
        # a text that starts with a space, or is empty, has no word before it
        bare = pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        each[starts[bare]] = 0
        return np.add.reduceat(each, starts) if len(starts) else np.zeros(0, np.int64)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter of a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(read_vocabulary(path)[0])
    return _counters[path]


def token_counts(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and n_tokens of every whole text.

    Null and empty texts have none, repeated rows are each counted, no rows give no rows, other columns are ignored. A text
    of any length is counted whole; a word of n characters takes memory in proportion to n while it is counted, and words of more
    than ``common.LONGEST_WORD`` characters are not remembered.
    """
    prepare(documents.sparkSession)

    def run(batches):
        counts = counter(vocabulary_path)
        for batch in batches:
            if batch.num_rows:
                found = pa.array(counts.counts(batch.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")
