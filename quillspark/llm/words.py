"""Words and word shingles of whole texts as 64-bit hash arrays.

A word is a maximal run of bytes outside the ASCII white space 0x20, 0x09-0x0D;
A-Z are lower-cased, all other bytes stay as they are.  ``bytes.lower`` and
``bytes.split`` have exactly these two meanings.
"""

from __future__ import annotations

import numpy as np
import xxhash

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words remembered per Python worker; beyond it the memory starts anew, results don't change.
CACHED_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, computed once for each word while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of a text's words, in order."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole sequence
    if it is shorter; none for no words."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, width)
    weights = odd_multipliers(k, 7 + k)
    total = words[: n - k + 1] * weights[0]
    for i in range(1, k):
        total = total + mix(words[i : n - k + 1 + i] + weights[i]) * weights[i]
    return np.unique(mix(total))
