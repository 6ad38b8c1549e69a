"""Vectorised 64-bit hashing of words and word shingles."""

from __future__ import annotations

import functools

import numpy as np

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x9E3779B97F4A7C15)
WORDS = 5
#: The bytes that part words: space, and tab to carriage return.
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


@functools.lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: As for search terms: every ASCII character that is no letter or digit.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(raw: bytes, gaps: np.ndarray = _SPACE) -> np.ndarray:
    """A hash of each word, of the bytes with A-Z lower-cased."""
    data = np.frombuffer(raw.lower(), np.uint8)
    gap = np.concatenate([[True], gaps[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    inside = letters()[data[~gap[1:-1]]] * _powers(1 << int(size.max()).bit_length())[place]
    return mixed(np.add.reduceat(inside, np.cumsum(size) - size) + size.astype(np.uint64) * _STEP)


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, of the whole sequence."""
    h = word_hashes(raw)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * _STEP + h[k : len(h) - n + 1 + k])
    return np.unique(out + mixed(np.full(1, n, np.uint64)))
