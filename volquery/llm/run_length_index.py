"""A run-length index: the Burrows-Wheeler transform of a small collection, kept as runs, with samples at
run boundaries, from which matching statistics stream in text order."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of ``text`` (small non-negative symbols), and the ranks at each depth on the way:
    equal ranks mean equal substrings of that length."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(6, np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i : i + n]
    levels, depth = [], 7
    while True:
        order = np.argsort(key)  # equal keys may come in any order: they share a rank
        ordered = key[order]
        change = np.empty(n, dtype=np.int64)
        change[0] = 0
        change[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(change)
        levels.append((depth, rank.astype(np.int32)))
        if rank[order[-1]] == n - 1 or depth >= n:
            return order, levels
        after = np.zeros(n, dtype=np.int64)
        after[: n - depth] = rank[depth:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        depth *= 2


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """Longest common prefixes of suffixes ``a`` and ``b``, by the largest equal blocks first."""
    out = np.zeros(len(a), dtype=np.int64)
    for depth, rank in reversed(levels):
        x, y = a + out, b + out
        inside = (x + depth <= n) & (y + depth <= n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        out[same] += depth
    return out  # less than 7 short, made up below the first level by the caller


class RunLengthIndex:
    """Runs of equal symbols of the transform, with the text positions at both ends of each run."""

    def __init__(self, text: np.ndarray) -> None:
        self.text, n = text, len(text)
        order, self.levels = suffix_order(text)
        before = text[order - 1]  # position 0 wraps to the last symbol
        heads = np.empty(n, dtype=bool)
        heads[0], heads[1:] = True, before[1:] != before[:-1]
        heads |= order == 0
        heads[1:] |= order[:-1] == 0  # nothing stands before position 0
        self.run_starts = np.flatnonzero(heads)
        self.symbols = before[self.run_starts]
        self.lengths = np.diff(np.append(self.run_starts, n))
        ends = np.append(self.run_starts[1:], n) - 1
        self.first, self.above = order[self.run_starts], order[np.maximum(self.run_starts - 1, 0)]
        self.last, self.below = order[ends], order[np.minimum(ends + 1, n - 1)]

    def _prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.text)
        out = common_prefix(a, b, self.levels, n)
        for _ in range(6):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += (a + out < n) & (b + out < n) & (self.text[x] == self.text[y])
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest string that starts there and also elsewhere.

        A suffix and its neighbour in the same run are one symbol longer in the neighbouring order of
        the position before, so prefixes only need comparing at run ends; between these samples, in
        text order, they lose one symbol a step."""
        n = len(self.text)
        best = np.zeros(n, dtype=np.int64)
        for own, other in ((self.first, self.above), (self.last, self.below)):
            sample = np.full(n, -1, dtype=np.int64)
            sample[own] = np.where(own == other, 0, self._prefix(own, other))
            at = np.where(sample >= 0, np.arange(n), 0)
            at = np.maximum.accumulate(at)
            value = np.where(sample[at] >= 0, sample[at] - (np.arange(n) - at), 0)
            best = np.maximum(best, value)
        return best


def repeated_starts(pieces: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each piece (bytes), whether the ``length`` bytes from each start also start elsewhere."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    text = np.zeros(int(sizes.sum()) + len(pieces), dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    for p, end in zip(pieces, ends.tolist()):
        text[end - 1 - len(p) : end - 1] = p.astype(np.int64) + 1
    found = RunLengthIndex(text).matching_statistics() >= length
    return [found[end - 1 - size : end - size + max(0, size - length)] if size >= length else np.zeros(0, bool) for size, end in zip(sizes.tolist(), ends.tolist())]
