"""Word hashes and rolling hashes of word windows, vectorised over many texts at once."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

# Odd multipliers, so that they have inverses modulo 2**64.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def hash_words(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and where each text's words start (n + 1 places).

    Words are what lies between the bytes 0x20 and 0x09 to 0x0D.
    """
    words, starts = [], [0]
    for text in texts:
        words += text.split()
        starts.append(len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), dtype=np.uint64, count=len(words))
    return hashes, np.array(starts, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Polynomial hashes modulo 2**64 of any range of a sequence, from running sums."""

    def __init__(self, hashes: np.ndarray, multiplier: int = FIRST):
        n = len(hashes)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, multiplier, np.uint64))))
            inverse = pow(multiplier, -1, 1 << 64)
            self.back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64))))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)))

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each [start, end); equal sequences of equal length have equal hashes."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` items, by its start."""
        return mixed((self.sums[size:] - self.sums[: len(self.sums) - size]) * self.back[: len(self.sums) - size])
