"""Boosted regression trees on histograms: least squares, leaf by leaf. A fit takes arrays that fit a task."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Trees, shrinkage, leaves of a tree, least rows of a leaf, ridge on leaf values, bins of a feature (at most 254; one more is for null)."""

    rounds: int = 200
    rate: float = 0.1
    leaves: int = 31
    least: int = 40
    ridge: float = 1.0
    bins: int = 254


class Boosted:
    """A fitted model. Null features are nan, and larger than any number."""

    def __init__(self, edges: list[np.ndarray], start: float, trees: list[tuple[np.ndarray, ...]]):
        self.edges, self.start, self.trees = edges, start, trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int32)
            while (inner := feature[at] >= 0).any():
                here = at[inner]
                at[inner] = np.where(b[rows[inner], feature[here]] <= cut[here], left[here], right[here])
            out += value[at]
        return out


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending edges of each column: between distinct values where these are few, else quantiles."""
    out = []
    for c in x.T:
        seen = np.unique(c[~np.isnan(c)])
        out.append((seen[1:] + seen[:-1]) / 2 if len(seen) <= bins else np.unique(np.quantile(c[~np.isnan(c)], np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    b = np.empty(x.shape, np.int32)
    for k, e in enumerate(edges):
        b[:, k] = np.where(np.isnan(x[:, k]), len(e) + 1, np.searchsorted(e, x[:, k]))
    return b


class _Bins:
    """The bins of all features in one row: where each feature's begin, the feature of each bin, and bins that a split can end with."""

    def __init__(self, edges: list[np.ndarray]):
        sizes = np.array([len(e) + 2 for e in edges])
        self.first = np.cumsum(sizes) - sizes
        self.total = int(sizes.sum())
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        self.ends = np.ones(self.total, bool)
        self.ends[self.first + sizes - 1] = False


class _Node:
    """Rows of a node with the histograms of their residuals, and its best split."""

    __slots__ = ("rows", "sums", "counts", "total", "gain", "feature", "cut")

    def __init__(self, rows: np.ndarray, sums: np.ndarray, counts: np.ndarray, bins: _Bins, shape: Shape):
        self.rows, self.sums, self.counts = rows, sums, counts
        n, run = len(rows), np.cumsum(sums)
        s = self.total = float(run[bins.first[1] - 1] if len(bins.first) > 1 else run[-1])
        # every feature's bins hold all rows, so what stands before a feature is its place times the total
        nl, sl = np.cumsum(counts) - n * bins.feature, run - s * bins.feature
        nr = n - nl
        at = np.flatnonzero(bins.ends & (nl >= shape.least) & (nr >= shape.least))
        self.gain, self.feature, self.cut = -np.inf, -1, 0
        if len(at):
            gain = sl[at] ** 2 / (nl[at] + shape.ridge) + (s - sl[at]) ** 2 / (nr[at] + shape.ridge)
            k = int(gain.argmax())
            self.gain = float(gain[k] - s**2 / (n + shape.ridge))
            self.feature = int(bins.feature[at[k]])
            self.cut = int(at[k] - bins.first[self.feature])


def fit(x: np.ndarray, y: np.ndarray, shape: Shape = Shape()) -> Boosted:
    """The model of rows x (nan for null) and outcomes y. No rows: a model that says 0."""
    if not len(y):
        return Boosted([np.zeros(0)] * x.shape[1], 0.0, [])
    edges = bin_edges(x, shape.bins)
    b, p = binned(x, edges), x.shape[1]
    bins = _Bins(edges)
    flat = b + bins.first.astype(np.int32)
    start = float(y.mean())
    guess, trees = np.full(len(y), start), []
    every, base = np.arange(len(y)), np.bincount(flat.ravel(), minlength=bins.total)

    def histograms(rows: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = flat[rows].ravel()
        return np.bincount(at, np.repeat(rest[rows], p), bins.total), np.bincount(at, minlength=bins.total)

    for _ in range(shape.rounds):
        rest = y - guess
        root = _Node(every, np.bincount(flat.ravel(), np.repeat(rest, p), bins.total), base, bins, shape)
        nodes, heap = [root], [(-root.gain, 0)]
        feature, cut, left, right = [-1], [0], [-1], [-1]
        leaves = 1
        while heap and leaves < shape.leaves:
            gain, k = heapq.heappop(heap)
            if -gain <= 1e-9:
                break
            node = nodes[k]
            goes = b[node.rows, node.feature] <= node.cut
            parts = [node.rows[goes], node.rows[~goes]]
            small = int(len(parts[1]) < len(parts[0]))
            made: list[_Node | None] = [None, None]
            sums, counts = histograms(parts[small], rest)
            made[small] = _Node(parts[small], sums, counts, bins, shape)
            made[1 - small] = _Node(parts[1 - small], node.sums - sums, node.counts - counts, bins, shape)
            feature[k], cut[k], left[k], right[k] = node.feature, node.cut, len(nodes), len(nodes) + 1
            for child in made:
                heapq.heappush(heap, (-child.gain, len(nodes)))
                nodes.append(child)
                for column, none in ((feature, -1), (cut, 0), (left, -1), (right, -1)):
                    column.append(none)
            node.sums = node.counts = None
            leaves += 1
        value = np.zeros(len(nodes))
        for k, node in enumerate(nodes):
            if feature[k] < 0:
                value[k] = shape.rate * node.total / (len(node.rows) + shape.ridge)
                guess[node.rows] += value[k]
        trees.append((np.array(feature, np.int16), np.array(cut, np.int16), np.array(left, np.int16), np.array(right, np.int16), value))
    return Boosted(edges, start, trees)
