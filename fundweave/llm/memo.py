"""A bounded memory, within one Python worker, of what a pure function gave for a hashed key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Memo:
    """Maps 64-bit keys to short runs of numbers. Beyond `limit` keys it starts afresh, so memory is bounded and the
    results stay the same."""

    def __init__(self, dtype: type, limit: int = 1 << 20) -> None:
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.pool = np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def look_up(self, keys: np.ndarray, compute: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The slot of each of the sorted distinct keys. compute(positions) gives the lengths and the concatenated
        numbers of those keys that are new."""
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = place < len(self.keys)
        known[inner] = self.keys[place[inner]] == keys[inner]
        new = np.flatnonzero(~known)
        if len(new):
            lengths, flat = compute(new)
            first = len(self.at) - 1
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
            self.pool = np.concatenate([self.pool, flat.astype(self.dtype)])
            self.slots = np.insert(self.slots, place[new], first + np.arange(len(new)))
            self.keys = np.insert(self.keys, place[new], keys[new])
            place = np.searchsorted(self.keys, keys)
        return self.slots[place]
