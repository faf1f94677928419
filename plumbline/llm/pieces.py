"""A task's memory of pieces of text that were turned into token ids before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from plumbline.llm.bytesops import Hashing, ragged


class PieceMemo:
    """Token ids of pieces of bytes; ``encode`` is asked once for each distinct piece.

    Pieces are told apart by a 64-bit hash. The memory is a few flat arrays, and
    starts anew when it holds more than ``most`` pieces.
    """

    def __init__(self, encode: Callable[[bytes], list[int]], most: int = 500_000):
        self.encode = encode
        self.most = most
        self.hashing = Hashing(11)
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)
        self.starts = np.empty(0, dtype=np.int32)
        self.lengths = np.empty(0, dtype=np.int32)
        self.flat = np.empty(0, dtype=np.int32)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data[start:end], one range after the other, and the number of ids before each range."""
        before = np.zeros(len(starts) + 1, dtype=np.int64)
        if len(starts) == 0:
            return np.empty(0, dtype=np.int32), before
        hashes, first, back = np.unique(self.hashing.words(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        inside = at < len(self.known)
        found = np.zeros(len(hashes), dtype=bool)
        found[inside] = self.known[at[inside]] == hashes[inside]
        if not found.all():
            if len(self.known) + np.count_nonzero(~found) > self.most:
                self._forget()
                found[:] = False
            self._learn(hashes[~found], data, starts[first[~found]], ends[first[~found]])
            at = np.searchsorted(self.known, hashes)
        lengths = self.lengths[at][back]
        np.cumsum(lengths, out=before[1:])
        return self.flat[ragged(self.starts[at][back].astype(np.int64), lengths.astype(np.int64))], before

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        low = int(starts.min())
        text = data[low: int(ends.max())].tobytes()
        encode = self.encode
        made = [encode(text[a:b]) for a, b in zip((starts - low).tolist(), (ends - low).tolist())]
        lengths = np.fromiter(map(len, made), dtype=np.int32, count=len(made))
        begin = (len(self.flat) + np.cumsum(lengths, dtype=np.int64) - lengths).astype(np.int32)
        self.flat = np.concatenate([self.flat, np.fromiter((i for m in made for i in m), dtype=np.int32)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.starts = np.concatenate([self.starts, begin])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]
