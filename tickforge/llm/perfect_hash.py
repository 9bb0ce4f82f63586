"""Minimal perfect hashing of sets of unsigned 64-bit keys.

Keys are thrown into a bit array twice as large as their number; those that are alone at their
place are settled, the others are thrown into a smaller array of the next level, until none is
left. A key's index is the number of set bits before its own in all levels: 0 to n - 1, each once.
The keys themselves stand in a table by their index, so a key that was not in the set is found out.
"""

from __future__ import annotations

import numpy as np

SPREAD = 2


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Keys as well spread 64-bit numbers, others for each seed."""
    x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """`sizes` of the levels' bit arrays, their `bits` one after another, and `keys` by index."""

    def __init__(self, sizes: np.ndarray, bits: bytes, keys: np.ndarray):
        self.sizes, self.bits, self.keys = sizes, bits, keys
        self._set = np.unpackbits(np.frombuffer(bits, np.uint8))[: int(sizes.sum())].astype(bool)
        self._before = np.cumsum(self._set) - self._set

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The function of these keys, which must be distinct."""
        sizes, levels, left = [], [], keys
        while len(left):
            sizes.append(SPREAD * len(left))
            places = _places(left, len(sizes), sizes[-1])
            alone = np.bincount(places, minlength=sizes[-1]) == 1
            levels.append(alone)
            left = left[~alone[places]]
        bits = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
        found = cls(np.array(sizes, np.int64), bits.tobytes(), keys)
        by_index = np.empty_like(keys)
        by_index[found._index(keys)] = keys
        found.keys = by_index
        return found

    def _index(self, keys: np.ndarray) -> np.ndarray:
        out, left, begin = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist(), 1):
            places = _places(keys[left], level, size) + begin
            hit = self._set[places]
            out[left[hit]] = self._before[places[hit]]
            left, begin = left[~hit], begin + size
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for those that are not in the set."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        found = self._index(keys)
        return np.where((found >= 0) & (self.keys[found] == keys), found, -1)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys, level) % np.uint64(size)).astype(np.int64)
