"""A k-d tree over vectors of letter counts, searched by the sum of absolute differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: One count for each of a-z; other letters share what is left, by their code.
LATIN, DIMS = 26, 32
#: Distances worked out at a time.
CELLS = 1 << 17


def letter_counts(words: list[str]) -> np.ndarray:
    """A row per word; counts stop at 30,000, which keeps distances right or too small, never too large."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    dims = np.where((codes >= 97) & (codes < 123), codes - 97, LATIN + codes % (DIMS - LATIN))
    at = np.repeat(np.arange(len(words)), lengths) * DIMS + dims
    counts = np.bincount(at, minlength=len(words) * DIMS).reshape(len(words), DIMS)
    return np.minimum(counts, 30_000).astype(np.int16)


class LetterTree:
    """Built over ``vectors``; a node is cut until it has at most ``leaf`` of them or they are equal.

    With ``whole`` the boxes of the nodes cover all vectors there can be, also those not seen, and the tree serves to
    send vectors to leaves; else boxes fit tightly around the vectors.
    """

    def __init__(self, vectors: np.ndarray, leaf: float, whole: bool = False):
        self.vectors = vectors
        self.cuts: list[tuple[int, int, int] | None] = []  # left child, right child, leaf number or -1
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        floor, ceiling = np.zeros(DIMS, np.int16), np.full(DIMS, 32_000, np.int16)
        todo = [(np.arange(len(vectors)), floor, ceiling, -1, 0)]
        while todo:
            rows, low, high, parent, side = todo.pop()
            here = vectors[rows]
            if not whole and len(rows):
                low, high = here.min(axis=0), here.max(axis=0)
            node = len(self.cuts)
            self.low.append(low)
            self.high.append(high)
            if parent >= 0:
                above = list(self.cuts[parent])
                above[side] = node
                self.cuts[parent] = tuple(above)
            cut = self._best_cut(here) if len(rows) > max(leaf, 1) else None
            if cut is None:
                self.cuts.append((-1, -1, len(self.leaves)))
                self.leaves.append(rows)
                continue
            self.cuts.append((-1, -1, -1))
            dim, at = cut
            below = here[:, dim] <= at
            left_high, right_low = high.copy(), low.copy()
            left_high[dim], right_low[dim] = at, at + 1
            todo.append((rows[below], low, left_high, node, 0))
            todo.append((rows[~below], right_low, high, node, 1))

    @staticmethod
    def _best_cut(here: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that halve the vectors best; none if all are equal."""
        best, found = 1.0, None
        for at in range(int(here.max(initial=0))):
            off = np.abs((here <= at).mean(axis=0) - 0.5)
            dim = int(off.argmin())
            if off[dim] < min(best, 0.5):
                best, found = off[dim], (dim, at)
            if at >= 3 and found:
                break
        return found

    def search(self, asked: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``asked``) wherever the box of a leaf is within ``radius`` of rows."""
        todo = [(0, np.arange(len(asked)))]
        while todo:
            node, rows = todo.pop()
            here = asked[rows]
            gap = np.maximum(np.maximum(self.low[node] - here, here - self.high[node]), 0).sum(axis=1)
            rows = rows[gap <= radius]
            if not len(rows):
                continue
            left, right, leaf = self.cuts[node]
            if leaf >= 0:
                yield leaf, rows
            else:
                todo += [(left, rows), (right, rows)]

    def pairs(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``asked``, row of the tree) of all pairs within ``radius``, in portions."""
        for leaf, rows in self.search(asked, radius):
            mine = self.leaves[leaf]
            here = self.vectors[mine]
            step = max(1, CELLS // max(len(mine), 1))
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                apart = np.abs(asked[some][:, None, :] - here[None, :, :]).sum(axis=2, dtype=np.int32)
                a, b = np.nonzero(apart <= radius)
                if len(a):
                    yield some[a], mine[b]
