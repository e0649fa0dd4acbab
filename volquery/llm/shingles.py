"""Sets of word shingles of whole texts, as sorted distinct hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import text_buffers, word_bounds

WIDTH = 5
_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word, ASCII letters in lower case: a polynomial in its bytes."""
    n = len(data)
    powers = np.ones(n + 1, np.uint64)
    inverse = np.ones(n + 1, np.uint64)
    powers[1:], inverse[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
    return _mix((sums[stops] - sums[starts]) * inverse[starts])


def shingle_sets_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of all texts end to end, sorted within each, and the n + 1 offsets
    of the texts.  Fewer words than ``width`` are one shingle; no words, none."""
    data, offsets = text_buffers(texts)
    starts, stops, counts = word_bounds(data, offsets)
    words = word_hashes(data, starts, stops)
    row = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(words) - width + 1)
    joined = np.zeros(n, np.uint64)
    for i in range(width):
        joined = joined * np.uint64(_BASE) + words[i : i + n]
    inside = row[:n] == row[width - 1 :] if n else np.zeros(0, bool)
    joined, owner = _mix(joined[inside]), row[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        few = np.array([_few(words[first[r] : first[r] + counts[r]]) for r in short], dtype=np.uint64)
        at = np.searchsorted(owner, short)
        joined, owner = np.insert(joined, at, few), np.insert(owner, at, short)
    edges = np.searchsorted(owner, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        joined[a:b].sort()
    fresh = np.ones(len(joined), bool)
    fresh[1:] = (joined[1:] != joined[:-1]) | (owner[1:] != owner[:-1])
    return joined[fresh], np.searchsorted(owner[fresh], np.arange(len(counts) + 1))


def _few(words: np.ndarray) -> int:
    value = len(words)
    for w in words.tolist():
        value = (value * _BASE + w) & (2**64 - 1)
    return value


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    return shingle_sets_of(pa.array([text.decode()]), width)[0]


def set_id(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9
