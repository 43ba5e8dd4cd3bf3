"""Word and shingle hashes over a batch of texts.

Words are `[^\\x20\\x09-\\x0D]+`. A word's 64-bit hash is the blake2b digest of its
bytes, taken once for each distinct word and looked up for the others; hashes of
windows are sums of them with odd factors, then mixed.
"""

from __future__ import annotations

import hashlib

import numpy as np

_STEPS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C2B5D6F0E1A7E13]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class WordHasher:
    """Keeps the hashes of words between calls: at most MOST_KEPT words of at most LONGEST_KEPT bytes; others are hashed anew."""

    MOST_KEPT, LONGEST_KEPT = 300_000, 64

    def __init__(self, lower: bool = True):
        self.lower, self.known = lower, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > self.MOST_KEPT:
                self.known.clear()
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    found[i] = h = self.known.get(w) or word_hash(w)
                    if len(w) <= self.LONGEST_KEPT and len(self.known) <= self.MOST_KEPT:
                        self.known[w] = h
        return np.fromiter(found, np.uint64, len(words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, bounds): text i has the words bounds[i]:bounds[i+1]."""
        found, bounds = [np.zeros(0, np.uint64)], [0]
        for t in texts:
            blob = t.encode("utf-8", "replace")
            words = (blob.lower() if self.lower else blob).split()  # bytes: A-Z alone are lowered, [\x20\x09-\x0D] alone split
            found.append(self.hashes(words))
            bounds.append(bounds[-1] + len(words))
        return np.concatenate(found), np.array(bounds)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` (at most 8) words in one flat array."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += words[k : k + n] * np.uint64(_STEPS[k])
    return mix(out)


def shingle_sets(hasher: WordHasher, texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one, with none the set is empty."""
    words, bounds = hasher(texts)
    every = windows(words, size)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(windows(words[a:b], b - a) if b > a else every[:0])
    return out
