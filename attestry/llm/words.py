"""Words of whole texts as numpy arrays: the shared inner step of the text operators.

A word is a run of bytes other than space and tab to carriage return. Null texts
count as empty. All work is on arrays of one batch; a batch is taken in groups of
documents so that memory follows ``GROUP_BYTES``, or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 21
HASH_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * HASH_BYTES)
        have = (_powers(_BASE, size), _powers(_INVERSE, size))
        if size <= 2 * HASH_BYTES:
            _POWERS[0] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``most`` bytes together, or one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of some documents: byte ranges, document of each, first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        data = _LOWER[data] if lower else data
        inside = ~_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.data = data
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, equal for equal words in any batch."""
        out = np.empty(len(self.start), dtype=np.uint64)
        a = 0
        while a < len(out):
            b = int(np.searchsorted(self.end, self.start[a] + HASH_BYTES, side="right"))
            b = max(b, a + 1)
            base, top = self.start[a], self.end[b - 1]
            up, down = _power_tables(top - base + 1)
            sums = np.zeros(top - base + 1, dtype=np.uint64)
            np.cumsum((self.data[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=sums[1:])
            s, e = self.start[a:b] - base, self.end[a:b] - base
            out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            a = b
        return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on, for positions that have so many after them."""
    size = max(len(words) - n + 1, 0)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = mix(out + words[k : k + size] * (_BASE + np.uint64(2 * k)))
    return out
