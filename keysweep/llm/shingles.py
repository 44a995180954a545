"""Word shingles of texts as sorted 64-bit hashes, for the n-gram Jaccard join."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd factors, one for each word of a shingle.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                    dtype=np.uint64)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S33)) * _A
    x = (x ^ (x >> _S29)) * _B
    return x ^ (x >> _S33)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash."""

    #: Words that one worker remembers; on overflow all go.
    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


#: This worker's words.
WORDS = WordHashes()


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words (A-Z lower-cased, words are what ASCII white space
    separates); with fewer words the whole sequence is one shingle; without words there are none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b"\0".join(words), seed=len(words))], dtype=np.uint64)
    hashed = np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total = mix(total + hashed[j:j + n] * _FACTORS[j % len(_FACTORS)])
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]
