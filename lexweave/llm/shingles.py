"""Words, word n-grams and their hashes, the same on every machine."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Longest runs of letters or digits.
WORD = re.compile(r"[^\W_]+")

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all when it holds `limit` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n successive words, in order; empty if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h + words[k : k + m]) * _M1
        h = h ^ (h >> np.uint64(29))
    return mix(h * _M2)


def distinct_ngrams(text: str, n: int, known: WordHashes) -> np.ndarray:
    """The text's distinct n-gram hashes, ascending."""
    return np.unique(ngram_hashes(word_hashes(text, known), n))
