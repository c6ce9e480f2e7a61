"""Vectorized hashes of words and shingles over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes hashed at once; longer texts are cut at separators, so memory doesn't follow a text's length.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
EXACT = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
EXACT[SEPARATOR] = 0
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
_powers: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, dtype=U64)
        steps[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(steps)
    return have[:n]


def _hashed(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    word = ~SEPARATOR[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, U64)
    sums = np.add.reduceat(table[b] * powers(BASE, len(b)), starts)
    return mix(sums * powers(INVERSE, len(b))[starts])


def word_hashes(text: bytes, table: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit hash of every word in order. ``table``: EXACT, or LOWER to hash A-Z as a-z."""
    b = np.frombuffer(text, np.uint8)
    if len(b) <= CHUNK:
        return _hashed(b, table)
    parts, at = [], 0
    while at < len(b):
        end = min(len(b), at + CHUNK)
        while end < len(b):
            near = np.flatnonzero(SEPARATOR[b[max(at, end - 4096) : end]])
            if len(near):
                end = max(at, end - 4096) + int(near[-1]) + 1
                break
            end = min(len(b), end + 4096)
        parts.append(_hashed(b[at:end], table))
        at = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of ``n`` words in a row; of fewer words, one hash of the whole sequence."""
    if not len(words):
        return np.empty(0, U64)
    k = min(n, len(words))
    odd = [U64((0x9E3779B97F4A7C15 * (2 * i + 3)) & (2**64 - 1) | 1) for i in range(k)]
    total = np.full(len(words) - k + 1, U64(0x632BE59BD9B4E019 * k & (2**64 - 1)), dtype=U64)
    for i, m in enumerate(odd):
        total += mix(words[i : len(words) - k + 1 + i] * m)
    return np.unique(mix(total))
