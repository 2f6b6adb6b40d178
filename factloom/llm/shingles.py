"""Words and word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker remembers, and the bytes of the longest that it does: together they bound its memory.
CACHED_WORDS, CACHED_BYTES = 400_000, 64
# Odd multipliers of the shingle hash.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class WordHash(dict):
    """Maps a word's bytes to its 64-bit hash; keeps a bounded number of bounded words."""

    def __missing__(self, word: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) > CACHED_WORDS:
                self.clear()
            self[word] = v
        return v


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased and nothing else."""
    return text.encode().lower().split() if text else []


def hashes(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX[0]
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words, in order; of all words together where there are fewer."""
    n = min(n, len(h))
    if n == 0:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * MIX[k % 5] + h[k : len(h) - n + 1 + k])
    return out
