"""Words, runs of words and their hashes, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Everything but a-z and 0-9 parts words.
_BLANK = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_MAX_CACHED = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """The maximal runs of a-z and 0-9 in the lower-cased text."""
    return text.lower().encode("ascii", "replace").translate(_BLANK).split() if text else []


def bare(text: str | None) -> bytes:
    """The words of the text, parted by single blanks."""
    return b" ".join(text.lower().encode("ascii", "replace").translate(_BLANK).split()) if text else b""


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten when too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MAX_CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all the others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def run_hashes(lists: list[list[bytes]], n: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each list, one after the other, and the number of runs of each."""
    counts = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((cache[w] for x in lists for w in x), dtype=np.uint64, count=int(counts.sum()))
    runs = np.maximum(counts - n + 1, 0)
    if not runs.sum():
        return np.empty(0, dtype=np.uint64), runs
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[first + k] * _ODD[k % len(_ODD)]
    return mix(h), runs
