"""Words of whole texts as numbers, for operators that compare sequences of words."""

from __future__ import annotations

import numpy as np
import xxhash

MAX_WORDS = 1 << 17
#: Odd multipliers of the rolling hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order."""
    if words.size < n:
        return np.empty(0, np.uint64)
    size = words.size - n + 1
    with np.errstate(over="ignore"):
        out = words[:size].copy()
        for k in range(1, n):
            out = out * STEP + words[k : k + size]
        return mix(out)
