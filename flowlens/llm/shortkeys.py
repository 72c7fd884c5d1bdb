"""Exact look-up of many byte strings of one buffer at once.

Keys of at most 16 bytes are held as two 64-bit words and a length in an open
addressing table, so a probe compares whole keys and no hash stands for one.
Longer keys are looked up in a dictionary.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U64 = np.uint64
#: Bytes that a key in the table has at most.
SHORT = 16
#: Bytes that a buffer must have behind its last key.
PAD = SHORT + 8
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], U64)


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(PAD), np.uint8)


def _words(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    view = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    return (view[start] & _MASK[np.minimum(size, 8)], view[start + 8] & _MASK[np.clip(size - 8, 0, 8)])


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b * U64(0x9FB21C651E98DF25))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(29))


class ByteTable:
    """``keys`` (distinct) with one value from 0 up each."""

    def __init__(self, keys: Sequence[bytes], values: Sequence[int]):
        self.long = {k: int(v) for k, v in zip(keys, values) if len(k) > SHORT}
        short = [(k, int(v)) for k, v in zip(keys, values) if len(k) <= SHORT]
        slots = 1 << max(4, (2 * len(short)).bit_length())
        self._and = U64(slots - 1)
        self.a, self.b = np.zeros(slots, U64), np.zeros(slots, U64)
        self.size = np.full(slots, 255, np.uint8)              # 255: empty
        self.value = np.full(slots, -1, np.int32)
        size = np.fromiter((len(k) for k, _ in short), np.int64, len(short))
        a, b = _words(padded(b"".join(k for k, _ in short)), np.cumsum(size) - size, size)
        value = np.fromiter((v for _, v in short), np.int32, len(short))
        at = (_slot(a, b) & self._and).astype(np.int64)
        left, self.probes = np.arange(len(short)), 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.size[at[left]] == 255)
            slot, first = np.unique(at[left[free]], return_index=True)
            won = left[free[first]]
            self.a[slot], self.b[slot], self.size[slot], self.value[slot] = a[won], b[won], size[won], value[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & (slots - 1)

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The value of each ``buf[start:end]``, -1 where it is no key.
        ``buf`` ends with ``PAD`` bytes of which no key is a part."""
        size = end - start
        out = np.full(len(start), -1, np.int32)
        open_ = np.flatnonzero(size <= SHORT)
        a, b = _words(buf, start[open_], size[open_])
        n = size[open_]
        at = (_slot(a, b) & self._and).astype(np.int64)
        for _ in range(self.probes):
            there = self.size[at]
            hit = (there == n) & (self.a[at] == a) & (self.b[at] == b)
            out[open_[hit]] = self.value[at[hit]]
            on = np.flatnonzero(~hit & (there != 255))
            if not len(on):
                break
            open_, a, b, n = open_[on], a[on], b[on], n[on]
            at = (at[on] + 1) & (len(self.size) - 1)
        if self.long:
            for i in np.flatnonzero(size > SHORT).tolist():
                out[i] = self.long.get(buf[start[i]:end[i]].tobytes(), -1)
        return out
