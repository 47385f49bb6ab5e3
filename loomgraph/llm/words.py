"""Words of whole texts as numpy arrays: positions, owners and 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than space and tab to carriage return, which is the pattern
`[^\\x20\\x09-\\x0D]+` on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to the largest n of 4 million."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (a finaliser of shifts and odd multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """The words of a run of documents.

    data: all bytes; bounds: document i holds data[bounds[i]:bounds[i + 1]]; start, end: of each word in data;
    first: words first[i] .. first[i + 1] - 1 belong to document i.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        solid = np.zeros(len(data) + 1, bool)
        np.logical_not(SPACE[data], out=solid[:-1])
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        inner = bounds[bounds < len(data)]
        opens[inner] = solid[inner]
        closes = solid[:-1] & ~solid[1:]
        last = bounds[(bounds > 0) & (bounds <= len(data))] - 1
        closes[last] = solid[last]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.n_docs = len(bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every process."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(self.data) + 1, np.uint64)
        # +1 lets no byte vanish, so a word and the same word with zero bytes added differ
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(self.data)), out=total[1:])
        own = (total[self.end] - total[self.start]) * powers(BASE_INVERSE, len(self.data))[self.start]
        return mix(own)

    def bytes_of(self, i: int, j: int) -> bytes:
        """Words i .. j - 1 of one document joined by one space."""
        return b" ".join(bytes(self.data[self.start[i] : self.end[j - 1]]).split()) if j > i else b""


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values of h, at the place of the first; the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * np.uint64(pow(BASE, k + 1, 1 << 64))
    return mix(out)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string or binary Arrow array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive runs of documents of about `most` bytes; a longer document is a run of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_runs(column: pa.Array, fold: bool = False, most: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first document, last + 1, their words) over a column; fold: A-Z lower-cased."""
    data, bounds = texts_of(column)
    for i, j in slices(bounds, most):
        part = data[bounds[i] : bounds[j]]
        yield i, j, Words(FOLD[part] if fold else part, bounds[i : j + 1] - bounds[i])


def text_blocks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Stretches of the batches that hold about `most` bytes in their column `text`; a longer text is one of its own."""
    for b in batches:
        bounds = texts_of(b.column("text"))[1]
        for i, j in slices(bounds, most):
            yield b.slice(i, j - i)


def ids_of(column: pa.Array) -> np.ndarray:
    """Row ids as int64; null becomes the largest value, which ranks after every id."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
