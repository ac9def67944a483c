"""Hashed word-shingle sets of a batch of texts, without a Python loop over words.

A word's hash is a polynomial over a random table of byte values, taken as a
difference of running sums modulo 2**64; a shingle's hash mixes those of its
words. Two different shingles share a 64-bit hash with probability 2**-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    value = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    folded = value.copy()
    folded[65:91] = value[97:123]  # A-Z read as a-z
    separator = np.zeros(256, bool)
    separator[[9, 10, 11, 12, 13, 32]] = True
    return folded, separator, value


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(1 << n.bit_length(), 1 << 20)  # over n; a power of two, so that it is seldom made again
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of the bytes of each span; ``value`` gives the number of each byte."""
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_tables()[2] if value is None else value)[raw] * up[:len(raw)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the number of words before each text (one longer)."""
    value, separator, _ = _tables()
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = mix(span_hashes(raw, starts, ends, value))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle."""
    words, first = word_hashes(raw, offsets)
    factors = np.random.default_rng(21).integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    joined = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        joined += words[i:len(joined) + i] * factors[i]
    joined = mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            s = np.sort(joined[a:b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(mix(np.array([(words[a:b] * factors[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
