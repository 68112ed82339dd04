"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton recognises every run of words that occurs inside an item. Documents are streamed through it word by
word; the automaton's state carries the length of the longest match that ends at the word. Where that length reaches
the window, the words of the window are hit, and the state of the window's own length names the items it occurs in.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALPHANUMERIC, binary_texts, prepare

#: Words of an item that make a window; a shorter item is one window.
WINDOW = 10
#: Bytes of item text in one automaton. A benchmark beyond that is cut into blocks, each with its own pass.
BLOCK_BYTES = 4_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return text.translate(ALPHANUMERIC).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items of each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(item, words) for item, text in sorted(items, key=lambda x: (x[0], x[1] or b"")) if (words := words_of(text))]
        for _, words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.known = frozenset(self.next[0])
        #: state of the window's length -> items; state -> [(length, item)] of items shorter than the window
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, words in sequences:
            if len(words) < window:
                state = 0
                for word in words:
                    state = self.next[state][word]
                self.short.setdefault(state, []).append((len(words), item))
            else:
                state = length = 0
                for word in words:
                    state, length = self.step(state, length, word)
                    if length >= window:
                        self.items.setdefault(self.at_window(state), set()).add(item)
        self.least = min([window, *(length for marks in self.short.values() for length, _ in marks)])
        #: nearest state on the way to the root, itself included, where a short item ends
        self.marked = [-1] * len(self.next)
        if self.short:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                self.marked[state] = state if state in self.short else self.marked[self.link[state]]
        self.runs = re.compile(b"\x01{%d,}" % self.least)

    def _clone(self, p: int, q: int, word: bytes) -> int:
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        copy = self.link[q] = len(self.next) - 1
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # an earlier item has this run already
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, p = len(self.next) - 1, last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def step(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def at_window(self, state: int) -> int:
        """The state that holds the last ``window`` words of a match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit stretches [from, to) in ascending order, items with occurring windows, the longest match."""
        stretches: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        # a window can only lie in a run of words that the items have at all
        for run in self.runs.finditer(bytes(map(self.known.__contains__, words))):
            state = length = 0
            for i in range(run.start(), run.end()):
                state, length = self.step(state, length, words[i])
                longest = max(longest, length)
                back = 0
                if length >= self.window:
                    back = self.window
                    found |= self.items[self.at_window(state)]
                at = self.marked[state]
                while at > 0:
                    for size, item in self.short[at]:
                        if size <= length:
                            back = max(back, size)
                            found.add(item)
                    at = self.marked[self.link[at]]
                if back:
                    if stretches and stretches[-1][1] >= i + 1 - back:
                        start = stretches[-1][0]
                        while len(stretches) > 1 and stretches[-2][1] >= i + 1 - back:
                            stretches.pop()
                            start = stretches[-1][0]
                        stretches[-1] = (min(start, i + 1 - back), i + 1)
                    else:
                        stretches.append((i + 1 - back, i + 1))
        return stretches, found, longest


# One automaton for each benchmark block a worker has met lately, built where it is used.
_built: OrderedDict[tuple, SuffixAutomaton] = OrderedDict()


def _automaton(items: list[tuple[str, bytes | None]], window: int) -> SuffixAutomaton:
    key = (window, hashlib.sha256(repr(items).encode()).digest())
    if key not in _built:
        while len(_built) >= 2:
            _built.popitem(last=False)
        _built[key] = SuffixAutomaton(items, window)
    return _built[key]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """Items in blocks of a checked size; items without id or text take no part."""
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")
    )
    total = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    for block in range(count):
        chosen = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block)
        yield sorted((r["item"], bytes(r["text"])) for r in chosen.collect())


_STATE = (
    T.StructType()
    .add("hits", T.ArrayType(T.IntegerType()))
    .add("items", T.ArrayType(T.StringType()))
    .add("longest", T.IntegerType())
    .add("n_words", T.LongType())
)
_STATE_ARROW = [
    pa.field("hits", pa.list_(pa.int32())),
    pa.field("items", pa.list_(pa.string())),
    pa.field("longest", pa.int32()),
    pa.field("n_words", pa.int64()),
]


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _pass(df: DataFrame, items, window: int, first: bool) -> DataFrame:
    """Send ``row``, ``text`` (and what earlier blocks have found) through one block's automaton."""
    shared = df.sparkSession.sparkContext.broadcast(items)

    def scan(batches):
        automaton = _automaton(shared.value, window)
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            out: dict[str, list] = {f.name: [] for f in _STATE_ARROW}
            earlier = [None] * batch.num_rows if first else list(
                zip(columns["hits"].to_pylist(), columns["items"].to_pylist(), columns["longest"].to_pylist())
            )
            for text, was in zip(binary_texts(columns["text"]), earlier):
                words = words_of(text)
                stretches, found, longest = automaton.scan(words)
                if was:
                    stretches = _merged(stretches + list(zip(was[0][::2], was[0][1::2])))
                    found, longest = found | set(was[1]), max(longest, was[2])
                out["hits"].append([x for pair in stretches for x in pair])
                out["items"].append(sorted(found))
                out["longest"].append(longest)
                out["n_words"].append(len(words))
            kept = [(n, c) for n, c in columns.items() if n in ("row", "text")]
            made = [pa.array(out[f.name], type=f.type) for f in _STATE_ARROW]
            names = [n for n, _ in kept] + [f.name for f in _STATE_ARROW]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + made, names=names)

    schema = T.StructType([df.schema["row"], df.schema["text"], *_STATE.fields])
    return df.mapInArrow(scan, schema)


def match_benchmark(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Where documents repeat test items.

    Returns a row for each row of ``documents``: ``row`` (all its columns as a struct), ``text`` (as bytes), ``hits``
    (word positions from, to, from, to ...), ``items`` (ids as sorted strings), ``longest`` (the longest match in
    words) and ``n_words``. Null and empty texts have no words and no hits; repeated rows are each reported; an empty
    benchmark hits nothing; items of no words are ignored, items that share an id count as one; other columns are kept
    in ``row`` whatever their names. The benchmark is broadcast in blocks whose size is checked; texts are never cut.
    """
    prepare(documents.sparkSession)
    df = documents.select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("text"))
    for number, items in enumerate(_blocks(benchmark, block_bytes)):
        df = _pass(df, items, window, first=not number)
    return df


def report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    found = match_benchmark(documents.select("doc_id", "text"), benchmark, **options)
    hit = F.expr("aggregate(sequence(0, size(hits) div 2 - 1), 0L, (s, i) -> s + hits[2 * i + 1] - hits[2 * i])")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        F.when(F.size("hits") > 0, hit).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def remove_spans(
    documents: DataFrame, benchmark: DataFrame, max_span: int = 0, max_coverage: float = 1.0, **options
) -> DataFrame:
    """Documents without what they repeat of the test items.

    Stretches of more than ``max_span`` hit words are cut out of the text; a document of which more than
    ``max_coverage`` of the words are hit goes altogether. With ``max_coverage=0`` every document with a hit goes.
    All columns are kept, and texts without a hit stay as they are, byte by byte.
    """
    found = match_benchmark(documents, benchmark, **options)
    if max_coverage <= 0:
        return found.where(F.size("hits") == 0).select("row.*")
    word = re.compile(rb"[^ ]+")

    def cut(batches):
        for batch in batches:
            texts, keep = [], []
            for text, hits, n in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "n_words"))):
                pairs = list(zip(hits[::2], hits[1::2]))
                keep.append(not pairs or sum(b - a for a, b in pairs) <= max_coverage * n)
                pairs = [(a, b) for a, b in pairs if b - a > max_span]
                if pairs and keep[-1]:
                    at = [m.span() for m in word.finditer(text.translate(ALPHANUMERIC))]
                    pieces, end = [], 0
                    for a, b in pairs:
                        pieces.append(text[end : at[a][0]])
                        end = at[b - 1][1]
                    text = b"".join([*pieces, text[end:]])
                texts.append(text)
            out = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary())], names=["row", "text"])
            yield out.filter(pa.array(keep, pa.bool_()))

    row = found.schema["row"].dataType
    cleaned = found.mapInArrow(cut, T.StructType([found.schema["row"], found.schema["text"]]))
    return cleaned.select(
        *[F.col("text").cast("string").alias("text") if f.name == "text" else F.col(f"row.`{f.name}`") for f in row.fields]
    )
