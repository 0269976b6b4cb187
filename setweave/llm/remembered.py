"""Pieces of text that are remembered: found by a hash, told by their bytes."""

from __future__ import annotations

import numpy as np


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[a_at : a_at + length] and b[b_at : b_at + length] are equal, for each of many runs."""
    some = np.flatnonzero(length > 0)
    out = np.ones(len(length), bool)
    if len(some):
        n = length[some]
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[some] = np.logical_and.reduceat(a[np.repeat(a_at[some], n) + step] == b[np.repeat(b_at[some], n) + step], begin)
    return out


class Remembered:
    """Byte strings, numbered as they come, of which no two have one hash."""

    def __init__(self):
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hashes
        self.raw, self.used = np.zeros(1 << 16, np.uint8), 0
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray, raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each string raw[at : at + length] with hash ``h``, or -1."""
        out = np.full(len(h), -1)
        if not len(self.hashes) or not len(h):
            return out
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        number = self.number[place]
        some = np.flatnonzero((self.hashes[place] == h) & (self.length[number] == length))
        some = some[same_bytes(self.raw, self.at[number[some]], raw, at[some], length[some])]
        out[some] = number[some]
        return out

    def add(self, h: np.ndarray, raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Remember strings, but for those whose hash another has; the places of those taken, in the order of their numbers."""
        _, first = np.unique(h, return_index=True)
        place = np.searchsorted(self.hashes, h[first])
        taken = self.hashes[np.minimum(place, len(self.hashes) - 1)] == h[first] if len(self.hashes) else np.zeros(len(first), bool)
        first, place = first[~taken], place[~taken]
        n = length[first]
        size = int(n.sum())
        while self.used + size > len(self.raw):
            self.raw = np.concatenate((self.raw, np.zeros_like(self.raw)))
        step = np.arange(size) - np.repeat(np.cumsum(n) - n, n)
        self.raw[self.used : self.used + size] = raw[np.repeat(at[first], n) + step]
        numbers = len(self.at) + np.arange(len(first))
        self.at, self.length = np.concatenate((self.at, self.used + np.cumsum(n) - n)), np.concatenate((self.length, n))
        self.hashes, self.number = np.insert(self.hashes, place, h[first]), np.insert(self.number, place, numbers)
        self.used += size
        return first
