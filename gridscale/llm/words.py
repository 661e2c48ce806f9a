"""Word and shingle hashes of texts, computed with numpy inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[^\W_]+|\n")
#: Hash of a line end among tokens.
LINE_END = xxhash.xxh3_64_intdigest("\n")
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


class Words(dict):
    """64-bit hashes of words, remembered up to ``most`` at a time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def tokens(self, text: str, piece: int = 1_000_000) -> np.ndarray:
        """Hashes of the words and line ends; whole lines of some ``piece`` characters are taken apart at a time."""
        out, a = [], 0
        while not out or a < len(text):
            z = text.find("\n", a + piece)
            z = len(text) if z < 0 else z
            found = TOKEN.findall(text[a:z].lower())
            out.append(np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found)))
            a = z
        return np.concatenate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _Q
    return h ^ (h >> np.uint64(27))


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; a shorter text is one run of all its words, an empty one has none."""
    n = min(n, len(w))
    if n == 0:
        return w[:0]
    m = len(w) - n + 1
    h = w[:m].copy()
    for k in range(1, n):
        h = h * _P + w[k : k + m]
    return mix(h + np.uint64(n))


def shingles(w: np.ndarray, n: int = 5) -> np.ndarray:
    """The set of run hashes, sorted."""
    return np.unique(grams(w, n))
