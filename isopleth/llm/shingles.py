"""Words and word shingles as 64-bit hashes, in numpy, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash


def split_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit (SplitMix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words; of all the words together if there are fewer; none if there are none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mix64(out + hashes[k : n - width + 1 + k] + np.uint64(0x9E3779B97F4A7C15))
    return out


def multiset(values: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the i-th occurrence of a value gets a hash of its own."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    fresh = np.append(True, values[1:] != values[:-1])
    nth = np.arange(len(values)) - np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
    return np.sort(np.where(nth > 0, mix64(values + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), values))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets in the form of `multiset`: shared over united weight."""
    if not len(a) and not len(b):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)
