"""Word shingles as sorted arrays of 64-bit hashes, inside Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# words: runs of bytes outside \x20 and \x09-\x0D, after lower-casing A-Z;
# bytes.split() cuts at exactly these
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MAX_CACHED_WORDS = 200_000


class _WordHashes(dict):
    """64-bit hashes of words; emptied when it reaches its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def forget() -> None:
    """Drop the words that a task has met."""
    _hashes.clear()


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles, sorted. Fewer words are one
    shingle; a text without words (or null) has none."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(a))
    n = len(a) - k + 1
    h = a[:n].copy()
    for j in range(1, k):
        h *= MULTIPLIER
        h += a[j : j + n]
    h ^= h >> np.uint64(29)
    h *= MULTIPLIER
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
