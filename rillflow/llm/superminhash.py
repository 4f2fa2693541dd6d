"""SuperMinHash signatures of shingle sets, vectorised over the documents of a batch.

Each element of a set draws, from its hash, a random permutation of the
registers one place at a time (Fisher-Yates) and a random fraction with each
place.  In round j it offers its j-th register the value j + fraction; registers
keep the least.  So the ranks that an element gives to registers are a
permutation, hence correlated, and the estimate of the similarity varies less
than with independent hashes.  A set whose registers are all below j + 1 after
round j can't change any more and stops: large sets stop after one or two rounds.
"""

from __future__ import annotations

import numpy as np
import xxhash

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
EMPTY = M64
_STEP = 0x9E3779B97F4A7C15
_G = np.uint64(_STEP)


class WordHashes(dict):
    """64-bit hashes of words; emptied when it reaches its bound."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of size words, A-Z lower-cased; all words as one shingle if they are fewer.

    Words are runs without ASCII white space (bytes.split and bytes.lower know
    ASCII only, which is what is asked for).
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _G + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash registers, one row a set; an empty set has all registers at EMPTY."""
    n = len(sets)
    reg = np.full((n, m), EMPTY, np.uint64)
    flat = reg.reshape(-1)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    if not sizes.sum():
        return reg
    x = np.concatenate(sets)
    base = np.repeat(np.arange(n, dtype=np.int64) * m, sizes)
    perm = None
    for j in range(m):
        draw = mix(x + np.uint64(_STEP * (j + 1) & (1 << 64) - 1))
        k = j + (((draw >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        value = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
        if j:
            rows = np.arange(len(x))
            place = perm[rows, k]
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        else:
            place = k
        np.minimum.at(flat, base + place, value)
        open_sets = (sizes > 0) & (reg.max(axis=1) >= np.uint64((j + 1) << 32))
        if not open_sets.any():
            break
        keep = open_sets[base // m]
        if not j:
            x, base, k = x[keep], base[keep], k[keep]
            perm = np.empty((len(x), m), np.uint8 if m <= 256 else np.uint16)
            perm[:] = np.arange(m)
            perm[np.arange(len(x)), k] = 0
            perm[:, 0] = k
        elif not keep.all():
            x, base, perm = x[keep], base[keep], perm[keep]
    return reg
