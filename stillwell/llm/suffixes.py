"""Burrows-Wheeler transforms of sets of strings, and their merge by refining how they interleave."""

from __future__ import annotations

import numpy as np

#: Ends every string; letters are whole numbers from 1 to LARGEST.
END = 0
LARGEST = (1 << 16) - 1
#: Letters of a first sorting key.
PACKED = 4


def as_letters(strings: list[bytes], stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of letters of ``stride`` bytes each, one per string and phase, and the byte each letter starts at.

    The letters from byte 0, from byte 1, ... of a string are strings of their own, so every run of ``stride * k`` bytes
    is a run of k letters; bytes left over at an end are in no letter. Every string of letters is followed by an END,
    which has place -1. Places count through all strings. None of more than LARGEST different letters: use fewer bytes.
    """
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    starts = np.cumsum(sizes) - sizes
    phase = np.tile(np.arange(stride), len(strings))
    counts = np.maximum((np.repeat(sizes, stride) - phase) // stride, 0)
    first = np.cumsum(counts + 1) - counts - 1
    line = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (np.repeat(starts, stride) + phase)[line] + stride * step
    value = np.zeros(len(place), dtype=np.uint32)
    for k in range(stride):
        value = value << np.uint32(8) | data[place + k]
    kinds, code = np.unique(value, return_inverse=True)
    if len(kinds) > LARGEST:
        raise OverflowError("too many different letters")
    text, at = np.zeros(len(place) + len(counts), dtype=np.uint16), np.full(len(place) + len(counts), -1, dtype=np.int64)
    text[first[line] + step] = code + 1
    at[first[line] + step] = place
    return text, at


class Shard:
    """The suffixes of some strings of letters in order, as their transform ``bwt``: the letter before each, END at a start.

    ``text`` holds the strings, each followed by an END of its own, which is smaller than every letter; ends rank as
    their strings do. ``sa`` holds where each suffix starts, and the first ``count`` suffixes are the bare ends.
    """

    def __init__(self, text: np.ndarray):
        size = len(text)
        ends = np.flatnonzero(text == END)
        self.count = len(ends)
        left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(size)          # letters up to the end
        padded = np.concatenate([text, np.zeros(PACKED, dtype=np.uint16)]).astype(np.uint64)
        key = np.zeros(size, dtype=np.uint64)
        for k in range(PACKED):
            key = key << np.uint64(16) | np.where(k < left, padded[k:k + size], np.uint64(0))
        order, rank, fresh = self._ranked(key)
        width = PACKED
        while width <= left.max(initial=0) and not fresh.all():
            beyond = np.zeros(size, dtype=np.int64)
            inside = np.flatnonzero(left >= width)
            beyond[inside] = rank[inside + width]
            order, rank, fresh = self._ranked(rank * (size + 1) + beyond)
            width *= 2
        self.sa = order
        self.bwt = text[order - 1]                        # before the first string stands the last end

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stable order, dense ranks from 1 and the places in order where a new rank begins."""
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        return order, rank, fresh

    def before(self) -> np.ndarray:
        """Where in the order the suffix one letter longer stands, by counting letters alone; ends are left as 0."""
        order = np.argsort(self.bwt, kind="stable")
        out = np.zeros(len(order), dtype=np.int64)
        out[order[self.count:]] = np.arange(self.count, len(order))
        return out


def interleaved(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge transforms: entries (numbered shard by shard) in the order of their first ``depth`` letters, block starts, and prefixes.

    Each round moves every entry to the place its longer suffix takes: a stable deal by the letter before, so only
    transforms are read and no suffix is compared. After ``h`` rounds the interleaving is right for the first h
    letters, and two neighbours part exactly in the round after the letters they share; that is their common prefix,
    and ``depth`` where they have not parted. Entries of one block share ``depth`` letters; an end is never shared.
    """
    starts = np.cumsum([0, *[len(s.bwt) for s in shards]])
    bwt = np.concatenate([s.bwt for s in shards])
    longer = np.concatenate([s.before() + at for s, at in zip(shards, starts)]).astype(np.int32)
    ends = np.concatenate([np.arange(s.count) + at for s, at in zip(shards, starts)]).astype(np.int32)
    size, bare = len(bwt), len(ends)
    entry = np.arange(size, dtype=np.int32)
    place = np.arange(size, dtype=np.int32)
    block = np.zeros(size, dtype=np.int32)
    begins = np.zeros(size, dtype=bool)
    prefix = np.full(size, depth, dtype=np.int16)
    for h in range(depth):
        letter = bwt[entry]
        order = np.argsort(letter, kind="stable")
        letter, was = letter[order], block[order]
        entry = longer[entry[order]]
        entry[:bare] = ends
        fresh = np.empty(size, dtype=bool)
        fresh[0] = True
        np.logical_or(letter[1:] != letter[:-1], was[1:] != was[:-1], out=fresh[1:])
        fresh[:bare + 1] = True
        prefix[fresh & ~begins] = h
        begins = fresh
        if begins.all():
            break
        block = np.maximum.accumulate(np.where(begins, place, 0))
    return entry, begins, prefix
