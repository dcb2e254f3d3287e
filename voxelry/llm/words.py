"""Array-at-a-time word splitting of Arrow text columns.

Every Python operator of this package reads whole texts through these helpers:
one Arrow batch is viewed as a flat UTF-8 buffer, classified byte by byte with a
lookup table, and cut into words with a handful of NumPy passes.  Nothing here
loops over words or characters in Python.

All separators that the contracts use are ASCII, and UTF-8 never uses ASCII bytes
inside a longer sequence, so working on bytes is the same as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; a longer single document is taken whole.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, lower-case letters, everything beyond ASCII.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


class Text(NamedTuple):
    """Some consecutive rows: their bytes, and where each row starts and ends."""

    first: int  # row of the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows


class Words(NamedTuple):
    """The words of some rows, back to back."""

    data: np.ndarray  # uint8: the words' bytes without separators
    offsets: np.ndarray  # int64: word w is data[offsets[w]:offsets[w + 1]]
    rows: np.ndarray  # int64: row r has the words rows[r] to rows[r + 1]
    starts: np.ndarray  # int64: where each word starts in the text buffer

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def arrow(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(np.ascontiguousarray(self.offsets)), pa.py_buffer(self.data)])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """An exact integer code of each word, and the distinct words by code."""
        if not len(self):
            return np.zeros(0, np.int32), pa.array([], pa.large_binary())
        d = self.arrow().dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Text]:
    """The rows of a column in pieces of about ``size`` bytes, each of whole rows."""
    data, offsets = flat(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield Text(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def split(text: Text, word: np.ndarray, lower: bool = False) -> Words:
    """The maximal runs of bytes for which ``word`` is true, row by row."""
    data = LOWER[text.data] if lower else text.data
    offsets = text.offsets
    if not len(data):
        return Words(data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64))
    inside = word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
    finishes[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(finishes) + 1 - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return Words(data[inside], at, np.searchsorted(starts, offsets), starts)


def joined(words: Words) -> bytes:
    """All words, each with one space behind it; word w begins at offsets[w] + w."""
    n = len(words)
    out = np.full(len(words.data) + n, 0x20, np.uint8)
    out[np.arange(len(words.data)) + np.repeat(np.arange(n), words.lengths)] = words.data
    return out.tobytes()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, back to back."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_grown: dict[str, np.ndarray] = {"p": _powers(_BASE, 1), "q": _powers(_INVERSE, 1)}


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every task."""
    n = len(words.data) + 1
    if len(_grown["p"]) < n:
        _grown["p"], _grown["q"] = _powers(_BASE, n + (n >> 2)), _powers(_INVERSE, n + (n >> 2))
    sums = np.zeros(n, np.uint64)
    np.cumsum(_TABLE[words.data] * _grown["p"][: n - 1], out=sums[1:])
    a, b = words.offsets[:-1], words.offsets[1:]
    out = mixed((sums[b] - sums[a]) * _grown["q"][a] + (b - a).astype(np.uint64))
    if len(_grown["p"]) > 4 * CHUNK_BYTES:  # one very long document: don't keep its tables
        forget()
    return out


def forget() -> None:
    """Drops the tables of powers, which grow with the text that is worked on at once."""
    _grown["p"], _grown["q"] = _powers(_BASE, 1), _powers(_INVERSE, 1)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, given the words' hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : k + count]
    return mixed(out)
