"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    values = (values ^ values >> np.uint64(30)) * MIX[0]
    values = (values ^ values >> np.uint64(27)) * MIX[1]
    return values ^ values >> np.uint64(31)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; A-Z count as a-z, words end at ASCII white space.

    Fewer words give one hash of them all; no words give none.
    """
    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(codes))
    count = len(codes) - size + 1
    values = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        values = mixed(values * MULTIPLIER + codes[k:k + count])
    return np.unique(values)
