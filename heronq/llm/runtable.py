"""A bounded table from short runs of bytes to token ids, looked up for all runs of a batch at once.

Keys are the runs' bytes themselves (up to WIDTH, padded with zeros, so a run holds no NUL): what is found is exact. Longer
runs are kept in a dictionary.
"""

from __future__ import annotations

import numpy as np

from heronq.llm.common import mix

#: Bytes of a key, and 64-bit words that hold them.
WIDTH, WORDS = 24, 3
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def key_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The WORDS 64-bit words of each run; data has WIDTH bytes more than the runs need."""
    wide = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    return [wide[starts + 8 * k] & _MASK[np.clip(sizes - 8 * k, 0, 8)] for k in range(WORDS)]


class RunTable:
    """Open addressing; grows until it is cleared."""

    def __init__(self, bits: int = 14):
        self.clear(bits)

    def clear(self, bits: int = 14) -> None:
        self._room(bits)
        self.start, self.length = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.pool, self.n_pool, self.n = np.zeros(1 << 12, np.uint32), 0, 0
        self.long: dict[bytes, int] = {}

    def _room(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.keys = [np.zeros(1 << bits, np.uint64) for _ in range(WORDS)]
        self.value = np.zeros(1 << bits, np.int32)

    def _slot(self, words: list[np.ndarray]) -> np.ndarray:
        h = words[0] * _SPREAD[0]
        for w, s in zip(words[1:], _SPREAD[1:]):
            h = h ^ (w * s)
        return (mix(h) & np.uint64(self.mask)).astype(np.int64)

    def find(self, words: list[np.ndarray]) -> np.ndarray:
        """The number of each run's value, or -1."""
        at = self._slot(words)
        out = np.full(len(at), -1, np.int32)
        todo = None
        while True:
            got = [k[at] for k in self.keys]
            some = words if todo is None else [w[todo] for w in words]
            hit = got[0] == some[0]
            for g, s in zip(got[1:], some[1:]):
                hit &= g == s
            if todo is None:
                out[hit] = self.value[at[hit]]
            else:
                out[todo[hit]] = self.value[at[hit]]
            on = np.flatnonzero(~hit & (got[0] != 0))
            if not len(on):
                return out
            todo, at = on if todo is None else todo[on], (at[on] + 1) & self.mask

    def _place(self, words: list[np.ndarray], value: np.ndarray) -> None:
        todo, at = np.arange(len(value)), self._slot(words)
        while len(todo):  # each round puts one key in every free slot asked for
            free = np.flatnonzero(self.keys[0][at] == 0)
            slot, first = np.unique(at[free], return_index=True)
            won = free[first]
            for k, w in zip(self.keys, words):
                k[slot] = w[todo[won]]
            self.value[slot] = value[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def values(self, ids: list[np.ndarray]) -> np.ndarray:
        """Numbers of new values."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), len(ids)
        while self.n + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.n_pool + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if total:
            self.pool[self.n_pool : self.n_pool + total] = np.concatenate(ids)
        self.start[self.n : self.n + n] = self.n_pool + np.cumsum(sizes) - sizes
        self.length[self.n : self.n + n] = sizes
        self.n, self.n_pool = self.n + n, self.n_pool + total
        return np.arange(self.n - n, self.n, dtype=np.int32)

    def add(self, words: list[np.ndarray], ids: list[np.ndarray]) -> None:
        """New distinct keys and their ids."""
        value = self.values(ids)
        if 3 * self.n > 2 * self.mask:
            used = np.flatnonzero(self.keys[0])
            old, numbers = [k[used] for k in self.keys], self.value[used]
            self._room((2 * self.n).bit_length())
            self._place(old, numbers)
        self._place(words, value)

    def gather(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the values one after another, and their counts."""
        sizes = self.length[value]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[value] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.pool[at], sizes
