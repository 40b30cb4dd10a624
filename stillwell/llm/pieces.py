"""Texts cut into pieces such that equal windows always lie in pieces of one anchor."""

from __future__ import annotations

import numpy as np

from stillwell.llm.shingles import mixed

#: Bytes cut at once, and the bits that hold a place among them.
CHUNK = 1 << 20
PLACE_BITS = np.uint64(22)

_RANDOM = np.random.default_rng(12)
LETTERS = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < count:
        size = max(count, CHUNK + 4096)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b, dtype=np.uint64))])
                      for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:count], _POWERS[1][:count]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row, from minima of twice the width each time."""
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:len(values) - width + 1], low[width - span:]) if span < width else low


class Cut:
    """The pieces of a chunk: ``start`` of the first window, ``size`` in windows, ``anchor`` and ``content`` hashes.

    ``limits`` are where its texts end, and no window crosses them. The anchor of a window is, of all stretches of a
    third of its length in it, the one with the smallest hash, and the first of equals; so equal windows have equal
    anchors in one place. A piece is a run of windows with the same anchor in the same place of the text; it spans
    ``size + window - 1`` bytes.
    """

    def __init__(self, chunk: np.ndarray, limits: np.ndarray, window: int):
        self.window, size, third = window, len(chunk), max(1, window // 3)
        count = size - window + 1
        self.start = self.size = np.zeros(0, dtype=np.int64)
        self.anchor = self.content = np.zeros(0, dtype=np.uint64)
        valid = np.zeros(max(count, 0) + 1, dtype=np.int8)
        firsts = np.concatenate([[0], limits[:-1]])
        lasts = limits - window + 1                                    # one behind the last window of each text
        some = lasts > firsts
        if count <= 0 or not some.any():
            return
        power, self.inverse = powers(size + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[chunk] * power[:size])])
        self.own = mixed((self.sums[third:] - self.sums[:-third]) * self.inverse[:size - third + 1])
        ranked = (self.own >> PLACE_BITS << PLACE_BITS) | np.arange(len(self.own), dtype=np.uint64)
        best = window_minima(ranked, window - third + 1)
        valid[firsts[some]] += 1
        valid[lasts[some]] -= 1
        live = np.cumsum(valid[:-1]).astype(bool)
        change = np.concatenate([[True], best[1:] != best[:-1]])
        begins = live & (change | np.concatenate([[True], ~live[:-1]]))
        stops = live & np.concatenate([change[1:] | ~live[1:], [True]])
        self.start = np.flatnonzero(begins)
        self.size = np.flatnonzero(stops) - self.start + 1
        self.anchor = self.own[(best[self.start] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)]
        self.content = self.hashes(self.start, self.size + window - 1)

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of bytes."""
        return mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start] + length.astype(np.uint64))
