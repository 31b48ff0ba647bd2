"""Words of whole Arrow columns as binary Arrow arrays, and the best rows of blocks of scores: no loop over rows or words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pagemill.llm.common import string_bytes

#: Bytes of words: digits, letters and whatever is not ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
PIECE_BYTES = 1 << 22


def _cut(data: np.ndarray, starts: np.ndarray, first: int, last: int) -> int:
    """The last place up to `last`, or else the first behind it, where no word goes on: at a gap or a text's start."""
    step = last - first
    while last < len(data):
        inside = INSIDE[data[first : last + 1]]
        gaps = np.flatnonzero(~(inside[:-1] & inside[1:]))
        row = int(starts[np.searchsorted(starts, last, side="right") - 1])
        at = max(first + 1 + int(gaps[-1]) if len(gaps) else first, row)
        if at > first:
            return at
        last += step
    return len(data)


def word_pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, pa.LargeBinaryArray]]:
    """Pieces of a column of texts, cut between words: for each word of a piece its row, rising, and the words, A-Z as
    a-z. A null has no words. A piece has about `most` bytes, or one longer word."""
    data, starts = string_bytes(texts)
    first = 0
    while first < len(data):
        last = _cut(data, starts, first, min(len(data), first + most))
        own = data[first:last]
        inside = INSIDE[own]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = starts[np.searchsorted(starts, first) : np.searchsorted(starts, last)] - first
        begins[edges] = inside[edges]  # a text's first byte starts a word of its own
        begin = np.flatnonzero(begins)
        if len(begin):
            offsets = np.append(np.cumsum(inside)[begin] - 1, np.count_nonzero(inside)).astype(np.int64)
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[own[inside]])]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), buffers)
            yield np.searchsorted(starts, first + begin, side="right") - 1, words
        first = last


class Best:
    """The `k` best (score, then least id) of each of `n` askers, gathered from blocks of scores.

    `bound` is a score that a new row must reach: ties with the last of the best are taken in, so that ids decide them.
    """

    def __init__(self, n: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self._held = [np.zeros(0, np.int64)] * 3
        self._new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._size, self._room = 0, 4 * k * max(1, n)

    def add(self, asker: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs that reach the bound."""
        self._new.append((asker, ids, scores))
        self._size += len(asker)
        if self._size > self._room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Askers, ids and scores of the best so far, in order; the bounds rise to the last of them."""
        asker, ids, scores = (np.concatenate([a, *b]) for a, b in zip(self._held, zip(*self._new, strict=True), strict=True)) if self._new else self._held
        order = np.lexsort((ids, ~scores, asker))  # falling scores, the least of 64 bits too
        asker = asker[order]
        place = np.arange(len(asker)) - np.searchsorted(asker, asker)
        order = order[place < self.k]
        last = place[place < self.k] == self.k - 1
        asker, ids, scores = self._held = [asker[place < self.k], ids[order], scores[order]]
        self.bound[asker[last]] = np.maximum(self.bound[asker[last]], scores[last])
        self._new, self._size = [], 0
        return asker, ids, scores
