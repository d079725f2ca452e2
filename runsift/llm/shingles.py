"""Word shingles of texts as 64-bit hashes, on arrays of bytes.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z in lower case. A text's set has the hashes of
its distinct runs of ``size`` words; a shorter text has one, its whole sequence; a text without words has none.
"""

from __future__ import annotations

import string
from functools import lru_cache

import numpy as np

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _bytes(separators: bytes) -> np.ndarray:
    """A 64-bit value for each byte, the same for a letter in either case; 0 for separators."""
    out = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out[65:91] = out[97:123]
    out[list(separators)] = 0
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


#: Space and U+0009 to U+000D; these and ASCII punctuation.
SPACES = b"\t\n\v\f\r "
PUNCTUATION = SPACES + string.punctuation.encode()


def word_hashes(texts: list[bytes], separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    values = _bytes(separators)[data]
    inside = np.concatenate([[False], values != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    n = end - start
    first = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(first, n)
    size = 1 << max(10, int(n.max()).bit_length())
    sums = np.add.reduceat(values[inside[1:-1]] * _powers(size)[within], first)
    return mix(sums + n.astype(np.uint64)), counts


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes of one text, sorted."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _C2 + words[k:len(words) - size + 1 + k])
    return np.unique(out)
