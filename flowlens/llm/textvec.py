"""Token and substring hashes of whole Arrow batches, vectorised with numpy.

A buffer holds several texts, each followed by one line feed, so no token
crosses from a text into the next one.  Hash values depend only on the bytes
hashed, never on their place, the batch or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes of text handled at once (a longer single text is handled whole).
CHUNK = 1 << 18

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * CHUNK)
        inverse = pow(_BASE, -1, 1 << 64)
        steps = np.full(size, _BASE, U64)
        steps[0] = 1
        _pow = np.multiply.accumulate(steps)
        steps[1:] = inverse
        _inv = np.multiply.accumulate(steps)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any bits of the result can be used."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Substrings:
    """Hashes of any substrings of one byte buffer, from prefix sums."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        power, self._back = _powers(n + 1)
        self._sum = np.zeros(n + 1, U64)
        np.cumsum(_TABLE[buf] * power[:n], out=self._sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sum[end] - self._sum[start]) * self._back[start]
        return mix(raw + (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every substring of ``size`` bytes, by its start."""
        if len(self._sum) <= size:
            return np.zeros(0, U64)
        n = len(self._sum) - size
        return mix((self._sum[size:] - self._sum[:n]) * self._back[:n] + U64(size * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))


@dataclass
class Tokens:
    """Tokens of a chunk: hash, byte span in the chunk's buffer, text number;
    ``first[i]:first[i + 1]`` are the tokens of text ``i``."""
    buf: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    base: np.ndarray        # where each text begins in the buffer


def chunks(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, encoded texts) with at most ``limit`` bytes
    together, or one longer text.  A null text is an empty one."""
    group: list[bytes] = []
    size = at = 0
    for i, t in enumerate(texts):
        b = t if isinstance(t, bytes) else (t or "").encode()
        if group and size + len(b) > limit:
            yield at, group
            group, size, at = [], 0, i
        group.append(b)
        size += len(b) + 1
    if group:
        yield at, group


def joined(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of a group and where each text begins in it."""
    buf = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, group), np.int64, len(group)) + 1
    return buf, np.cumsum(lengths) - lengths


_KIND = np.ones(256, np.uint8)                      # 0 white space, 1 word, 2 other
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 2
_WORDS = (_KIND == 1).astype(np.uint8)
_SPACED = (_KIND > 0).astype(np.uint8)


def tokens(group: list[bytes], punctuation: bool = False, words: bool = False, subs: bool = False):
    """Tokens between white space; with ``punctuation`` a run of letters and
    digits and a run of other signs are tokens of their own; with ``words``
    only runs of letters and digits are tokens."""
    buf, base = joined(group)
    kind = (_WORDS if words else _KIND if punctuation else _SPACED)[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate(([0], edge)) if len(buf) else edge
    end = np.concatenate((edge, [len(buf)]))
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    s = Substrings(buf)
    first = np.searchsorted(start, np.append(base, len(buf)))
    doc = np.repeat(np.arange(len(group)), np.diff(first))
    t = Tokens(buf, s.hash(start, end), start, end, doc, first, base)
    return (t, s) if subs else t


_MULT = [U64(0x9FB21C651E98DF25), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3),
         U64(0x589965CC75374CC3), U64(0x1D8E4E27C47D124F), U64(0xEB44ACCAB455D165), U64(0xC2B2AE3D27D4EB4F)]


def ngrams(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` tokens of one text, number of its first
    token), in the order of the tokens."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[size - 1:] == doc[:n])
    h = np.zeros(len(at), U64)
    for k in range(size):
        h = (h ^ hashes[at + k]) * _MULT[k % len(_MULT)]
        h = h ^ (h >> U64(29))
    return mix(h), at


def shingles(t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the ``size``-token shingles; a text with fewer
    tokens, but some, has one shingle of all of them."""
    h, at = ngrams(t.hash, t.doc, size)
    doc = t.doc[at]
    count = np.diff(t.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(short), U64)
        for k in range(size - 1):
            more = count[short] > k
            tok = t.hash[np.minimum(t.first[short] + k, len(t.hash) - 1)]
            step = (whole ^ tok) * _MULT[k % len(_MULT)]
            whole = np.where(more, step ^ (step >> U64(29)), whole)
        h = np.concatenate((h, mix(whole + U64(1))))
        doc = np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
