"""Exact join of sets inside one region: pivots, Voronoi cells, triangle-inequality windows, recursion."""

from __future__ import annotations

import numpy as np

#: Two sets are linked at a Jaccard distance of REACH at most: 100 * common >= 80 * union.
REACH, EPS = 0.2, 1e-9
#: Pivots of one step inside a task; pairs of a shingle and a pivot counted at once.
PIVOTS, AT_ONCE = 8, 2_000_000


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * common >= 80 * (n + m - common)


class Region:
    """Sets (sorted distinct hashes) of the members of a region, and the components known so far."""

    def __init__(self, docs: np.ndarray, comps: np.ndarray, sets: list[np.ndarray]) -> None:
        self.docs, self.sets = docs, sets
        self.n = np.array([len(s) for s in sets], np.int64)
        self.comp = np.unique(comps, return_inverse=True)[1].astype(np.int64)
        self.links: list[tuple[int, int]] = []

    def unite(self, i: int, j: int) -> None:
        """A link between the members i and j; only links that join two components are kept."""
        a, b = self.comp[i], self.comp[j]
        if a != b:
            self.comp[self.comp == b] = a
            self.links.append((int(self.docs[i]), int(self.docs[j])))

    def common(self, rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Matrix rows x pivots: sizes of the intersections."""
        marks = np.concatenate([self.sets[p] for p in pivots])
        whose = np.repeat(np.arange(len(pivots)), self.n[pivots])
        order = np.argsort(marks, kind="stable")
        marks, whose = marks[order], whose[order]
        tokens = np.concatenate([self.sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), self.n[rows])
        lo, hi = np.searchsorted(marks, tokens, "left"), np.searchsorted(marks, tokens, "right")
        hit = np.flatnonzero(hi > lo)
        lo, times, owner = lo[hit], (hi - lo)[hit], owner[hit]
        out, ends, a = np.zeros(len(rows) * len(pivots), np.int64), np.cumsum(times), 0
        while a < len(times):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
            t = times[a:b]
            at = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(t)[:-1]]), t) + np.arange(t.sum())
            out += np.bincount(np.repeat(owner[a:b], t) * len(pivots) + whose[at], minlength=len(out))
            a = b
        return out.reshape(len(rows), len(pivots))

    def measure(self, rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distances rows x pivots; every linked pair is united."""
        common = self.common(rows, pivots)
        n, m = self.n[rows][:, None], self.n[pivots][None, :]
        for i, j in zip(*np.nonzero(linked(common, n, m)), strict=True):
            self.unite(pivots[j], rows[i])
        return 1 - common / (n + m - common)

    def join(self, rows: np.ndarray) -> None:
        """Unite all linked pairs among ``rows``: every pair of different components is compared, but for those that a window excludes."""
        todo = [rows]
        while todo:
            rows = todo.pop()
            if len(rows) < 2 or (self.comp[rows] == self.comp[rows[0]]).all():
                continue
            pivots, rest = chosen(rows)
            if len(pivots) > 1:
                self.measure(pivots, pivots)
            todo += [rest[part] for part in parts(self.measure(rest, pivots))]


def chosen(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, others): one pivot for a small region."""
    n = max(1, min(PIVOTS, len(rows) // 4))
    return rows[:n], rows[n:]


def parts(d: np.ndarray) -> list[np.ndarray]:
    """Places of the rows of ``d`` (distances to the pivots) in parts that hold every linked pair: Voronoi cells with the rows in their windows,
    or, where these overlap too much, stretches of the distance to the first pivot that lie further apart than a link reaches."""
    if not len(d):
        return []
    if d.shape[1] > 1:
        cells = voronoi(d)
        cells[:, np.bincount(d.argmin(axis=1), minlength=d.shape[1]) == 0] = False  # nobody is at home
        if cells.sum() <= 1.5 * len(d):
            return [np.flatnonzero(c) for c in cells.T]
    order = np.argsort(d[:, 0], kind="stable")
    return np.split(order, np.flatnonzero(np.diff(d[order, 0]) > REACH + EPS) + 1)


def voronoi(d: np.ndarray) -> np.ndarray:
    """Cells of each row from its distances to the pivots: that of the nearest pivot, and each in which a linked set may be at home.

    If x is at home with pivot p and d(x, y) <= r, then d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2r for every
    other pivot q.
    """
    return d <= d.min(axis=1)[:, None] + 2 * REACH + EPS


def partners(n: np.ndarray, counts: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Which sets may have a linked one, by the counts of their hashes in bins: a join under the coarser distance of these.

    1 - (sum of the lesser counts) / (sum of the larger ones) is a metric and never above the sets' distance, so the same pivots,
    cells and windows hold. Pairs of two ``upper`` sets don't count.
    """
    ok, todo = np.zeros(len(n), bool), [np.arange(len(n))]
    while todo:
        rows = todo.pop()
        if len(rows) < 2 or ok[rows].all():
            continue
        pivots, rest = chosen(rows)
        d = np.empty((len(rows), len(pivots)))
        for j, p in enumerate(pivots):
            common = np.minimum(counts[rows], counts[p]).sum(axis=1)
            d[:, j] = 1 - common / (n[rows] + n[p] - common)
            near = rows[(d[:, j] <= REACH + EPS) & (rows != p) & ~(upper[rows] & upper[p])]
            ok[near] = True
            ok[p] |= len(near) > 0
        todo += [rest[part] for part in parts(d[len(pivots) :])]
    return ok
