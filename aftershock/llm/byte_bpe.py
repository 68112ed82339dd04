"""Token ids of whole texts through a byte-level BPE file of the tokenizers library, batch by batch.

The library's own pattern cuts a text into pieces before it merges bytes, and never looks back. A batch is cut at places
where that pattern must cut, wherever the bytes on both sides settle it; the distinct pieces are told apart by Arrow, those
not met before go to the library, and the ids of the batch are gathered from those of its distinct pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces and ids that a worker remembers; longer pieces than that are never remembered.
REMEMBERED_BYTES = 10_000_000
LONGEST = 64
#: Longer texts are encoded part by part, so that what their pieces take in memory is bounded.
WINDOW = 16_000_000
#: Pieces sent to the library in one call.
PIECES = 512

# Classes of bytes. Letters beyond ASCII are those of two bytes after the leads below, all of which are letters but for the
# two signs of multiplication and division; whatever is not known to be of one class is never cut from its neighbours.
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _BLANK, _SPACE = range(7)
_LEADS = (0xC3, 0xC4, 0xC5, 0xD0, 0xD1)
_SIGNS = (0x97, 0xB7)  # after 0xC3


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        out[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _MARK
    out[list(_LEADS)] = _LETTER
    out[0x20] = _BLANK
    out[0x09:0x0E] = _SPACE
    return out


def _cuts() -> np.ndarray:
    """Whether the pattern must cut between two classes, as a table over 8 * before + after.

    A piece of the pattern is a run of letters, digits or marks with at most one blank before it, a contraction after
    a quote, or white space. White space of several characters is left to the library, as is what follows a quote.
    """
    out = np.zeros(64, bool)
    runs = (_LETTER, _DIGIT, _MARK)
    for before in (*runs, _QUOTE):
        for after in (_BLANK, _SPACE):
            out[8 * before + after] = True
    for before in runs:
        for after in (*runs, _QUOTE):
            out[8 * before + after] = before != after and (before, after) != (_MARK, _QUOTE)
    for after in (*runs, _QUOTE):
        out[8 * _SPACE + after] = True  # taken back where more white space stands before
    return out


_CLASS, _CUT = _byte_classes(), _cuts()
#: The end of a word before a blank and another word, where the pattern must cut.
_WORD_END = re.compile(r"[A-Za-z](?= [A-Za-z])")


def _classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte of UTF-8 text."""
    out = _CLASS[data]
    high = np.flatnonzero(data >= 0xC3)
    lead = high[_CLASS[data[high]] == _LETTER]
    out[lead + 1] = _LETTER
    sign = lead[(data[lead] == 0xC3) & np.isin(data[lead + 1], _SIGNS)]
    out[sign] = out[sign + 1] = _OTHER
    return out


def _piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that stand one after another; ``starts`` has the first byte of each text."""
    kind = _classes(data)
    cut = np.empty(len(data) + 1, bool)
    cut[1:-1] = _CUT[kind[:-1] << 3 | kind[1:]]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    space = np.flatnonzero(kind == _SPACE)
    inner = space[~first[space]]
    loose = np.isin(kind[inner - 1], (_OTHER, _BLANK, _SPACE))
    cut[inner[loose] + 1] = False
    cut[first] = True
    cut[-1] = False
    return np.flatnonzero(cut)


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array, offsets from 0."""
    if len(strings) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes first[0] .. first[0] + sizes[0] - 1, first[1] .. and so on."""
    ends = np.cumsum(sizes, dtype=np.int32)
    out = np.repeat((first - ends + sizes).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Encoder:
    """Ids of whole texts, equal to those of the library's ``encode`` with ``add_special_tokens=False``.

    As there, the string of an added token inside a text is that token; with ``encode_special_tokens`` it is ordinary text.
    """

    def __init__(
        self, path: str, encode_special_tokens: bool = False, remembered: int = REMEMBERED_BYTES, window: int = WINDOW
    ):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = encode_special_tokens
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        self.added = [] if encode_special_tokens else [t["content"] for t in declared.get("added_tokens") or []]
        size = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, others follow from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        #: bytes of each id: each character of a token stands for one byte
        self.widths = np.zeros(size, np.int64)
        for token, number in self.whole.get_vocab(with_added_tokens=False).items():
            self.widths[number] = len(token)
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        self.merges.pre_tokenizer = None
        resize = getattr(self.merges.model, "_resize_cache", None)
        if resize is not None:
            resize(0)
        self.remembered, self.window = remembered, window
        #: pieces met before, where their ids start in ``ids``, and how many they are
        self.pieces = pa.array([], pa.binary())
        self.first, self.sizes, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    @property
    def memory(self) -> int:
        """Bytes remembered."""
        return self.pieces.nbytes + self.first.nbytes + self.sizes.nbytes + self.ids.nbytes

    def _merged(self, pieces: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and their number for pieces of one run each: only the library's merges are needed."""
        found, sizes = [], []
        for i in range(0, len(pieces), PIECES):
            some = pieces[i : i + PIECES]
            mapped = b"\n".join(some.to_pylist()).decode("latin-1").translate(self.alphabet).split(self.alphabet[0x0A])
            ids = np.array(
                self.merges.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64
            )
            stops = np.cumsum(self.widths[ids])
            ends = np.cumsum([len(m) for m in mapped])
            last = np.searchsorted(stops, ends)
            if len(ids) == 0 or last[-1] != len(ids) - 1 or not (stops[last] == ends).all():
                raise ValueError("the tokenizer did not keep the pieces apart")
            found.append(ids.astype(self.dtype))
            sizes.append(np.diff(last, prepend=-1))
        return found, sizes

    def _piped(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and their number for texts that go through the library's whole pipeline."""
        found = [np.array(e.ids, self.dtype) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return found, [np.array([len(f) for f in found], np.int64)]

    def _learn(self, new: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
        """Pieces in a new order, their ids and sizes, and how many of them may be remembered, which come first."""
        data, offsets = _flat(new)
        width = np.diff(offsets)
        kind = _classes(data)
        rest = np.add.reduceat((kind == _OTHER) | (kind >= _QUOTE), offsets[:-1], dtype=np.int64) if len(new) else width
        simple = (rest == 0) | ((rest == 1) & (width > 1) & (data[offsets[:-1]] == 0x20))
        long = width > LONGEST
        order = np.concatenate([np.flatnonzero(m) for m in (simple & ~long, ~simple & ~long, simple & long, ~simple & long)])
        new, simple = new.take(pa.array(order)), simple[order]
        found, sizes = [], []
        turns = np.flatnonzero(np.diff(simple)) + 1
        for start, end in zip([0, *turns.tolist()], [*turns.tolist(), len(new)]):
            some = new[start:end]
            if len(some):
                f, s = self._merged(some) if simple[start] else self._piped(some.cast(pa.string()).to_pylist())
                found += f
                sizes += s
        ids = np.concatenate([np.zeros(0, self.dtype), *found])
        return new, ids, np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int32), len(new) - int(long.sum())

    def _codes(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of each distinct piece among the pieces at hand; first and number of ids of those, and their ids."""
        place = pc.index_in(distinct, value_set=self.pieces)
        unknown = place.is_null().to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        new, ids, sizes, keep = self._learn(distinct.filter(pa.array(unknown)))
        where = pc.index_in(distinct.filter(pa.array(unknown)), value_set=new).to_numpy(zero_copy_only=False)
        place[unknown] = len(self.pieces) + where
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        at_hand = (
            np.concatenate([self.first, first + np.int32(len(self.ids))]),
            np.concatenate([self.sizes, sizes]),
            np.concatenate([self.ids, ids]),
        )
        count, tokens = len(self.pieces) + keep, len(self.ids) + int(sizes[:keep].sum())
        self.pieces = pa.concat_arrays([self.pieces, new[:keep]])
        self.first, self.sizes, self.ids = at_hand[0][:count], at_hand[1][:count], at_hand[2][:tokens]
        if self.memory > self.remembered:
            self._forget(place[place < count])
        return place, *at_hand

    def _forget(self, used: np.ndarray) -> None:
        """Remember the pieces of the batch at hand alone, and none if these are too many."""
        size = self.sizes[used]
        self.pieces = self.pieces.take(pa.array(used))
        self.ids = self.ids[_ranges(self.first[used], size)]
        self.sizes, self.first = size, np.cumsum(size, dtype=np.int32) - size
        if self.memory > self.remembered // 2:
            self.pieces = self.pieces[:0].take(pa.array([], pa.int32()))
            self.first, self.sizes, self.ids = self.first[:0].copy(), self.sizes[:0].copy(), self.ids[:0].copy()

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and where each text's ids end. A null text is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        long = pc.greater(pc.binary_length(texts), self.window)
        if not pc.any(long).as_py():
            return self._encode(texts, end_id)
        # runs of texts of usual length, and each longer one in parts
        found, at, end = [], 0, [] if end_id is None else [end_id]
        for i in [*np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist(), len(texts)]:
            if i > at:
                ids, ends = self._encode(texts[at:i], end_id)
                found += np.split(ids, ends[:-1])
            if i < len(texts):
                parts = [self._encode(pa.array([p], pa.string()))[0] for p in self._parts(texts[i].as_py())]
                found.append(np.concatenate([*parts, np.array(end, self.dtype)]))
            at = i + 1
        return np.concatenate(found), np.cumsum([len(f) for f in found])

    def _parts(self, text: str) -> Iterator[str]:
        """The text in parts of about the window, each of which ends where a word does; whole if it holds an added token."""
        at = 0
        while len(text) - at > self.window and not any(content in text for content in self.added):
            cut = _WORD_END.search(text, at + self.window)
            if cut is None:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def _encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        special = np.zeros(len(texts), bool)
        for content in self.added:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        odd = texts.filter(pa.array(special)).to_pylist() if special.any() else []
        if odd:
            texts = pc.if_else(pa.array(special), "", texts)
        data, offsets = _flat(texts)
        starts = _piece_starts(data, offsets[:-1]) if len(data) else np.zeros(0, np.int64)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        place, first, sizes, ids = self._codes(coded.dictionary)
        # the end after each text, and texts with added tokens, are further pieces
        tail, lengths = self._piped(odd) if odd else ([], [])
        end = [] if end_id is None else [end_id]
        more = np.concatenate([*lengths, np.array([len(end)], np.int64)]).astype(np.int32)
        first = np.concatenate([first, len(ids) + np.cumsum(more, dtype=np.int32) - more])
        sizes = np.concatenate([sizes, more])
        ids = np.concatenate([ids, *tail, np.array(end, self.dtype)])
        codes = place[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int32)
        # after the pieces of each text: the text with added tokens, if it is one, then the end
        pieces = np.searchsorted(starts, offsets)
        at = np.repeat(pieces[1:], 1 + special)
        tails = np.full(len(at), len(sizes) - 1, np.int32)
        stops = np.cumsum(1 + special) - 1
        tails[stops[special] - 1] = len(sizes) - 1 - len(odd) + np.arange(len(odd))
        codes = np.insert(codes, at, tails)
        take = sizes[codes]
        ends = np.cumsum(take)[pieces[1:] + stops] if len(texts) else np.zeros(0, np.int64)
        return ids[_ranges(first[codes], take)], ends


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, encode_special_tokens: bool = False) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    key = (path, encode_special_tokens)
    if key not in _encoders:
        _encoders[key] = Encoder(path, encode_special_tokens)
    return _encoders[key]
