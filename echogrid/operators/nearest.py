"""Nearest points by a uniform grid of bins, searched in growing squares."""

from __future__ import annotations

import numpy as np

FEW = 48  # points up to which all are compared
PER_BIN = 2.0
ROWS = 4096  # positions that are searched together


def nearest_first(squared: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` smallest values of each row, ascending; equal values keep their order."""
    if k >= squared.shape[1]:
        return np.argsort(squared, axis=1, kind="stable")
    edge = np.partition(squared, k - 1, axis=1)[:, k - 1 : k]
    below, tied = squared < edge, squared == edge
    room = k - below.sum(axis=1, keepdims=True)
    chosen = below | (tied & (np.cumsum(tied, axis=1) <= room))
    found = np.nonzero(chosen)[1].reshape(len(squared), k)
    order = np.argsort(np.take_along_axis(squared, found, axis=1), axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1)


class Bins:
    """Points sorted by the square bin that they lie in."""

    def __init__(self, px: np.ndarray, py: np.ndarray):
        self.px, self.py = px.astype(float), py.astype(float)
        self.x0, self.y0 = self.px.min(), self.py.min()
        width, height = self.px.max() - self.x0, self.py.max() - self.y0
        self.side = max(np.sqrt(width * height * PER_BIN / len(px)), max(width, height) * PER_BIN / len(px), 1e-9)
        self.columns, self.rows = int(width / self.side) + 1, int(height / self.side) + 1
        self.at_c, self.at_r = self._bin(self.px, self.py)
        number = self.at_r * self.columns + self.at_c
        self.order = np.argsort(number, kind="stable")
        self.starts = np.searchsorted(number[self.order], np.arange(self.rows * self.columns + 1))

    def _bin(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, r = np.floor((x - self.x0) / self.side), np.floor((y - self.y0) / self.side)
        return np.clip(c, 0, self.columns - 1).astype(np.int64), np.clip(r, 0, self.rows - 1).astype(np.int64)

    def nearest(self, x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
        """Indices of the ``k`` nearest points of each position, ascending, equal distances by index; without the point ``own``, if given.

        The squares around a position grow until the ``k``-th distance is less
        than that to anything outside them.
        """
        k = min(k, len(self.px) - (own is not None))
        out = np.empty((len(x), k), np.int64)
        todo, ring = np.arange(len(x)), max(1, int(np.ceil((np.sqrt(k / PER_BIN) - 1) / 2)))
        while len(todo):
            left = [self._search(todo[low : low + ROWS], x, y, k, own, ring, out) for low in range(0, len(todo), ROWS)]
            todo, ring = np.concatenate(left), 2 * ring
        return out

    def _search(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray | None, ring: int, out: np.ndarray) -> np.ndarray:
        """Fill ``out`` for the positions that are proven in squares of ``ring`` bins to each side; the others."""
        c, r = self._bin(x[at], y[at])
        low_c, high_c, low_r, high_r = np.maximum(c - ring, 0), np.minimum(c + ring, self.columns - 1), np.maximum(r - ring, 0), np.minimum(r + ring, self.rows - 1)
        lines = high_r - low_r + 1
        which = np.repeat(np.arange(len(at)), lines)
        row = low_r[which] + np.arange(len(which)) - np.repeat(np.cumsum(lines) - lines, lines)
        begin, end = self.starts[row * self.columns + low_c[which]], self.starts[row * self.columns + high_c[which] + 1]
        size = end - begin
        which = np.repeat(which, size)
        point = self.order[np.arange(len(which)) - np.repeat(np.cumsum(size) - size - begin, size)]
        if own is not None:
            kept = point != own[at][which]
            which, point = which[kept], point[kept]
        squared = (x[at][which] - self.px[point]) ** 2 + (y[at][which] - self.py[point]) ** 2
        order = np.lexsort((point, squared, which))
        which, point, squared = which[order], point[order], squared[order]
        first = np.searchsorted(which, np.arange(len(at) + 1))
        enough = np.diff(first) >= k
        beyond = [  # how far the nearest place is that was not searched, on each side
            np.where(low_c > 0, x[at] - (self.x0 + low_c * self.side), np.inf), np.where(high_c < self.columns - 1, self.x0 + (high_c + 1) * self.side - x[at], np.inf),
            np.where(low_r > 0, y[at] - (self.y0 + low_r * self.side), np.inf), np.where(high_r < self.rows - 1, self.y0 + (high_r + 1) * self.side - y[at], np.inf),
        ]
        margin = np.minimum.reduce(beyond) - 1e-9 * self.side
        last = np.where(enough, squared[np.minimum(first[:-1] + k - 1, len(squared) - 1)], np.inf) if len(squared) else np.full(len(at), np.inf)
        proven = enough & (margin > 0) & (last < np.where(np.isinf(margin), np.inf, margin) ** 2)
        good = np.flatnonzero(proven)
        out[at[good]] = point[first[good][:, None] + np.arange(k)]
        return at[~proven]


def nearest_points(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """``Bins.nearest``, by plain comparison where points are few."""
    if len(px) > FEW:
        return Bins(px, py).nearest(x, y, k, own)
    squared = (x[:, None] - px[None, :]) ** 2 + (y[:, None] - py[None, :]) ** 2
    if own is not None:
        squared[np.arange(len(x)), own] = np.inf
    return nearest_first(squared, min(k, len(px) - (own is not None)))
