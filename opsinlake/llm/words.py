"""Words of Arrow text batches as numpy arrays. A word is a run of bytes other than the six ASCII blanks; bytes of
UTF-8 sequences are never blanks, so byte offsets cut at character borders."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

BLOCK_BYTES = 4 << 20  # texts handled at a time; a longer text is a block of its own
_PIECE = 1 << 20
_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words(NamedTuple):
    """Words of the rows of one block: byte range in ``data``, row, and the first word of every row (n_rows + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def utf8(column) -> pa.Array:
    """A text column without nulls, as one Arrow array with 64-bit offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string()).fill_null("")


def offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows) of a large_string array."""
    _, positions, data = texts.buffers()
    at = np.frombuffer(positions, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` bytes of text, or one row."""
    _, at = offsets(utf8(batch.column(column)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A large_string array without nulls, with only A to Z lower-cased."""
    data, at = offsets(texts)
    data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def split_words(texts: pa.Array, blank: np.ndarray = BLANK) -> Words:
    """Words of every row; ``blank`` marks the bytes that stand between words."""
    data, at = offsets(texts)
    solid = ~blank[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    border = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word ends with its text
    begins[border] = solid[border]
    ends[border - 1] = solid[border - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(data, start, end, row, first)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of SplitMix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hash of every word: a polynomial of its bytes, from prefix sums, so the same word has the same hash
    everywhere. Worked in pieces, so memory does not follow the length of a text."""
    out = np.empty(len(w.start), np.uint64)
    cuts = [0, *np.flatnonzero(np.diff(w.start // _PIECE)) + 1, len(w.start)] if len(w.start) else [0, 0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        base = int(w.start[a])
        part = w.data[base : int(w.end[b - 1])].astype(np.uint64)
        part += _U(1)
        power = _powers(_MULTIPLIER, len(part) + 1)
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = w.start[a:b] - base, w.end[a:b] - base
        out[a:b] = mix((total[e] - total[s]) * _powers(_INVERSE, len(part) + 1)[s] + (e - s).astype(np.uint64))
    return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(of, n: int) -> np.ndarray:
    known = _POWERS.get(int(of))
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * _PIECE), of, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[int(of)] = known
    return known


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes, in order (length n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _MULTIPLIER
        out += h[j : j + n]
    return mix(out)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the word ``k``-shingles of every row. A row of 1 to k - 1 words has one shingle, all its words."""
    w = split_words(texts)
    h = word_hashes(w)
    count = np.diff(w.first)
    g = grams(h, k)
    at = np.flatnonzero(w.row[: len(g)] == w.row[k - 1 : k - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
    rows, values = w.row[at], g[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            value[has] = value[has] * _MULTIPLIER + h[w.first[short][has] + j]
        rows, values = np.concatenate([rows, short]), np.concatenate([values, mix(value + count[short].astype(np.uint64))])
    return rows, values
