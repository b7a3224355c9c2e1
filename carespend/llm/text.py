"""Texts as byte arrays: vectorised helpers that run inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Bytes of text that a task handles at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Sets word hashes apart from other uses of the same function.
WORD_SEED = 0x5EED

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each begins and ends. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together, or one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0 to n - 1, modulo 2 to the 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class SpanHash:
    """64-bit hashes of any span of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(data) + 1)

    def of_fixed(self, n: int) -> np.ndarray:
        """Hashes of the ``n`` bytes from each position on, comparable with each other only."""
        return mixed((self.sums[n:] - self.sums[: len(self.sums) - n]) * self.back[: len(self.sums) - n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` holds, none across two texts: text number, start and end of each."""
    return mask_spans(inside[data], offsets)


def mask_spans(held: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a mark on each byte."""
    edge = np.zeros(len(held) + 1, bool)
    edge[offsets] = True
    begins, ends = held.copy(), held.copy()
    begins[1:] &= ~held[:-1] | edge[1:-1]
    ends[:-1] &= ~held[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return np.searchsorted(offsets, starts, "right") - 1, starts, np.flatnonzero(ends) + 1


def bytes_except(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that holds for every byte outside the given ranges, both ends included."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words of documents and benchmark items, and words between white space, as fixed by the query contracts.
ALNUM_WORD = bytes_except((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SPACED_WORD = bytes_except((0x20, 0x20), (0x09, 0x0D))


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct ones, and these as bytes; words must not overlap."""
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] += 1
    marks[ends] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, each distinct one hashed as bytes."""
    codes, distinct = distinct_words(data, starts, ends)
    return np.array([xxh3_64_intdigest(w, WORD_SEED) for w in distinct.to_pylist()], np.uint64)[codes]


class WordRuns:
    """Hashes of runs of words, from hashes of the 1, 2, 4, ... words from each place on.

    ``times`` is an odd number; runs are comparable within one such number only.
    """

    def __init__(self, hashes: np.ndarray, longest: int, times: int):
        self.times = np.uint64(times)
        self.levels = [hashes]
        while 2 << (len(self.levels) - 1) <= longest:
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(mixed(last[: max(0, len(last) - width)] * self.times + last[width:]))

    def of(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Two runs of a power of two, which may overlap, make up any run."""
        out = np.zeros(len(starts), np.uint64)
        lengths = np.broadcast_to(lengths, starts.shape)
        level = np.frexp(lengths)[1] - 1
        for k in np.unique(level):
            own = level == k
            held, a, n = self.levels[k], starts[own], lengths[own]
            out[own] = mixed(held[a] * self.times + held[a + n - (1 << int(k))]) + n.astype(np.uint64)
        return mixed(out)
