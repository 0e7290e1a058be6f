"""Sets of word shingles as sorted 64-bit hashes, computed over whole texts with array operations."""

from __future__ import annotations

import numpy as np

WORDS = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(WORDS)]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for b in (_BASE, _INVERSE):
            x = np.full(size, np.uint64(b))
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 1 << 22:  # those of a very long text aren't kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word: runs of bytes other than ASCII white space, A to Z as a to z."""
    codes = np.frombuffer(raw, np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = ~_SPACE[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_VALUE[codes] * up[: len(codes)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * down[starts]
    return mix(own + (ends - starts).astype(np.uint64) * _M2)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles; fewer words are one shingle, no words none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        joined = np.full(1, n, np.uint64) * _M1
        for k in range(n):
            joined += words[k : k + 1] * _PLACE[k]
        return mix(joined)
    joined = words[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        joined += words[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(mix(joined))
