"""An R-tree over count vectors, packed bottom-up, for one task's points."""

from __future__ import annotations

import numpy as np

GROUPS = 256
LEAF, FAN = 32, 16


def resolution(n: int) -> int:
    """Groups for a set of n tokens: GROUPS, doubled until there are as many as tokens."""
    return GROUPS << max(0, (max(n, 1) - 1).bit_length() - (GROUPS.bit_length() - 1))


def count_vector(hashes: np.ndarray) -> bytes:
    """How many of the tokens fall into each group, by the first bits of the hash; the width grows with the
    largest count. Summing neighbours gives the vector of half as many groups."""
    bits = resolution(len(hashes)).bit_length() - 1
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u2" if counts.max() < 65536 else "<u4").tobytes()


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(groups, -1).sum(axis=1, dtype=np.int64) if len(vector) > groups else vector


def vectors(packed: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The points at GROUPS groups, and each at its own resolution."""
    kinds = {1: "u1", 2: "<u2", 4: "<u4"}
    own = [np.frombuffer(x, dtype=kinds[len(x) // resolution(int(n))]) for x, n in zip(packed, sizes, strict=True)]
    coarse = [fold(x, GROUPS) for x in own]
    most = max((int(x.max(initial=0)) for x in coarse), default=0)
    return np.array(coarse, dtype="u1" if most < 256 else "u2" if most < 65536 else "u4").reshape(len(own), GROUPS), own


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least overlap of sets of n and m tokens at which 100 * overlap >= 75 * union: ceil(3 (n + m) / 7)."""
    return (3 * (np.asarray(n, dtype=np.int64) + m) + 6) // 7


class RTree:
    """Points ordered by size and by their heaviest halves, packed into leaves of LEAF and
    nodes of FAN; a node keeps the largest count of each coordinate and the smallest size.

    The overlap of two sets is at most the sum of the smaller counts by coordinate, and of a
    set with any member of a node at most that sum with the node's largest counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        half = points[:, : GROUPS // 2].sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((half, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order].astype(np.int64)
        self.levels = []
        top, least, most = self.points, self.sizes, self.sizes
        width = LEAF
        while len(top) > FAN:
            cut = np.arange(0, len(top), width)
            top, least, most = np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((top, least, most, width))
            width = FAN

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places (in ``order``) of points whose overlap with this one may suffice, best bound first."""
        if self.levels:
            at = np.arange(len(self.levels[-1][0]))
            for k in range(len(self.levels) - 1, -1, -1):
                top, least, most, width = self.levels[k]
                at = at[(4 * most[at] >= 3 * size) & (3 * least[at] <= 4 * size)]
                bound = np.minimum(top[at], point).sum(axis=1, dtype=np.int64)
                at = at[bound >= needed(least[at], size)]
                below = len(self.levels[k - 1][0]) if k else len(self.points)
                at = (at[:, None] * width + np.arange(width)).ravel()
                at = at[at < below]
        else:
            at = np.arange(len(self.points))
        m = self.sizes[at]
        at = at[(4 * m >= 3 * size) & (3 * m <= 4 * size)]
        bound = np.minimum(self.points[at], point).sum(axis=1, dtype=np.int64)
        fits = bound >= needed(self.sizes[at], size)
        at, bound = at[fits], bound[fits]
        return at[np.argsort(-bound, kind="stable")]


class Forest:
    """Union-find with the smallest place as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def spanning(ids: np.ndarray, packed: list[bytes], sizes: np.ndarray, sets: list[np.ndarray] | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(smallest id, id) for each id that links join to a smaller one.

    The tree bounds at GROUPS groups; pairs that pass are bounded again at the finer resolution of
    the two, as large sets need. Without ``sets``, two points link when that bound allows it; with them, when
    the true overlap suffices. Pairs that are joined already are passed over. ``sides``: only points
    of different sides are compared."""
    by_id = np.argsort(ids, kind="stable")
    ids, sizes = ids[by_id], sizes[by_id]
    points, fine = vectors([packed[i] for i in by_id], sizes)
    sets = [sets[i] for i in by_id] if sets is not None else None
    sides = sides[by_id] if sides is not None else None
    tree, forest = RTree(points, sizes), Forest(len(ids))
    for i in range(1, len(ids)):
        near = tree.order[tree.near(points[i], int(sizes[i]))]
        near = near[near < i]
        if sides is not None:
            near = near[sides[near] != sides[i]]
        for j in near.tolist():
            if forest.find(i) == forest.find(j):
                continue
            groups = min(len(fine[i]), len(fine[j]))
            if groups > GROUPS and np.minimum(fold(fine[i], groups), fold(fine[j], groups)).sum(dtype=np.int64) < needed(sizes[i], sizes[j]):
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both < needed(sizes[i], sizes[j]):
                    continue
            forest.join(i, j)
    return [(int(ids[r]), int(ids[i])) for i in range(len(ids)) if (r := forest.find(i)) != i]
