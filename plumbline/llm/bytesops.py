"""Vectorised work on UTF-8 bytes inside a task: words, hashes of words, hashes of runs of words.

A column of texts arrives as one Arrow buffer. Everything here works on that
buffer, so that no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

# The six bytes that separate words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

# Bytes handled at a time where an array of 8 bytes per byte of text is needed.
SLICE = 1 << 20
# Words longer than this get their hash from the whole word at once.
LONG_WORD = 256


def _odd_table(seed: int) -> tuple[np.ndarray, int]:
    random = np.random.default_rng(seed)
    table = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table, int(random.integers(1 << 62, dtype=np.uint64)) * 4 + 5


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Hashing:
    """One hash function for words and for runs of words; equal seeds give equal hashes."""

    def __init__(self, seed: int):
        self.seed = seed
        self.table, self.base = _odd_table(seed)
        self.run_base = _odd_table(seed + 1_000_003)[1]
        self._up = _powers(self.base, SLICE)
        self._down = _powers(_inverse(self.base), SLICE)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]; the ranges are in order and do not overlap."""
        out = np.empty(len(starts), dtype=np.uint64)
        long = ends - starts > LONG_WORD
        first = 0
        while first < len(starts):
            last = int(np.searchsorted(ends, starts[first] + SLICE, side="right"))
            if last <= first:
                first += 1
                continue
            low, high = int(starts[first]), int(ends[last - 1])
            sums = np.empty(high - low + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(self.table[data[low:high]] * self._up[: high - low], out=sums[1:])
            a, b = starts[first:last] - low, ends[first:last] - low
            out[first:last] = (sums[b] - sums[a]) * self._down[a]
            first = last
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), self.seed)
        return mixed(out + (ends - starts).astype(np.uint64))

    def runs(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hashes of every run of ``size`` neighbouring words; len(words) - size + 1 of them."""
        n = len(words)
        if n < size:
            return np.empty(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * _powers(self.run_base, n)[:n], out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * _powers(_inverse(self.run_base), n)[: n - size + 1])


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of MurmurHash3)."""
    h = values ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the len + 1 bounds of the texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    column = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    low, high = int(bounds[0]), int(bounds[-1])
    bytes_ = np.frombuffer(data, dtype=np.uint8)[low:high] if high > low else np.empty(0, dtype=np.uint8)
    return bytes_, bounds - low


def edges(inside: np.ndarray, bounds: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes; runs end at the bounds and at the cuts."""
    if len(inside) == 0:
        none = np.empty(0, dtype=np.int64)
        return none, none
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(inside)]
    begins[inner] = inside[inner]
    if cuts is not None:
        begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the len + 1 bounds of the texts counted in words."""
    starts, ends = edges(~IS_SPACE[data], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def run_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Positions of words at which a run of ``size`` words of one text begins; bounds are in words."""
    n = int(bounds[-1])
    fits = np.zeros(n + 1, dtype=np.int32)
    lengths = np.diff(bounds)
    has = lengths >= size
    np.add.at(fits, bounds[:-1][has], 1)
    np.add.at(fits, bounds[1:][has] - size + 1, -1)
    return np.flatnonzero(np.cumsum(fits[:n]) > 0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words data[start:end] joined by one space."""
    if len(starts) == 0:
        return b""
    lengths = (ends - starts + 1).astype(np.int64)
    out = data[np.minimum(ragged(starts, lengths), len(data) - 1)]
    out[np.cumsum(lengths) - 1] = 32
    return out[:-1].tobytes()


def text_groups(bounds: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes; a longer text stands alone."""
    groups, first = [], 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = max(last, first + 1)
        groups.append((first, last))
        first = last
    return groups
