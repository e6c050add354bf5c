"""Word shingles as sets of 64-bit hashes, in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: A worker forgets the words it has hashed when it knows so many.
_REMEMBER = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBER:
            self.clear()
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """The hashes of a text's words in order, A-Z taken as a-z.

        On bytes, lower() knows A-Z alone, and split() just the white space of ASCII.
        """
        found = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingle_set(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; a shorter text is one shingle, one without words none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    size = min(n, width)
    windows = np.full(n - size + 1, size, np.uint64) * _GOLD
    for i in range(size):
        windows = mix64(windows + _GOLD) ^ word_hashes[i : n - size + 1 + i]
    return np.unique(mix64(windows))
