"""Word hashes and shingle sets of whole texts, in bulk."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_KEPT = 100_000
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """64-bit hash of a word; words are remembered up to a bound, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


HASHES = WordHashes()


def word_hashes(texts):
    """Hashes of the words of each text in turn, A-Z in lower case. `bytes.split` cuts at exactly the six ASCII blanks."""
    for t in texts:
        words = t.lower().split()
        yield np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of the whole sequence where it is shorter; none of no words."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    span = min(n, width)
    h = np.zeros(n - span + 1, dtype=np.uint64)
    for k in range(span):
        h = h * STEP + words[k : n - span + 1 + k]
    return np.unique(mixed(h + np.uint64(span)))
