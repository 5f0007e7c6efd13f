"""Hashes of words and of word runs, vectorised over a text."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
SHINGLE = 5
_digest = xxhash.xxh3_64_intdigest
#: Odd 64-bit multipliers, one for each place of a run, made by a fixed rule.
PLACES = np.array([xxhash.xxh3_64_intdigest(b"place%d" % i) | 1 for i in range(64)], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the input over the output."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` words (at most 64)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out += h[i : i + n] * PLACES[i]
    return mixed(out)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = word_hashes(words)
    return np.unique(run_hashes(own, SHINGLE) if len(own) >= SHINGLE else run_hashes(own, len(own)) ^ np.uint64(len(own)))
