"""A vectorised open-addressing hash table over uint64 keys, used for level tables and dictionaries of integers."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """Maps distinct uint64 keys to int64 values; all operations take arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(3, int(2 * max(1, len(keys)) - 1).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._values = np.zeros(1 << bits, np.int64)
        self._used = np.zeros(1 << bits, bool)
        keys = keys.astype(np.uint64)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[~self._used[slot[left]]]
            # of several keys that want a free slot the last one written gets it
            self._keys[slot[free]] = keys[free]
            won = free[self._keys[slot[free]] == keys[free]]
            self._used[slot[won]] = True
            self._values[slot[won]] = values[won]
            left = left[~(self._used[slot[left]] & (self._keys[slot[left]] == keys[left]))]
            slot[left] = (slot[left] + 1) & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where a key is absent."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            hit = self._used[at] & (self._keys[at] == keys[left])
            out[left[hit]] = self._values[at[hit]]
            left = left[self._used[at] & ~hit]
            slot[left] = (slot[left] + 1) & self._mask
        return out
