"""Boosted regression trees for a series that fits into one task, on numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Cut points of a feature, at most; features with fewer values are cut between all of them.
CUTS = 255
#: Slots that the rows behind summed entries are dealt to.
SLOTS = 64


@dataclass(frozen=True)
class TreeSettings:
    """Squared error; a leaf is the sum of its residuals over their number plus ``penalty``."""

    trees: int
    rate: float
    depth: int
    least_rows: int
    row_share: float
    column_share: float
    seed: int
    penalty: float = 1.0


class BoostedTrees:
    """``fit`` then ``predict``; every tree sees a share of the rows and of the columns, drawn from the seed."""

    def __init__(self, settings: TreeSettings) -> None:
        self.settings = settings

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, x[:, j], side="left") for j, cuts in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, slot: np.ndarray | None = None) -> BoostedTrees:
        """``weight`` and ``slot``: an entry stands for so many rows of equal features, ``y`` being the sum of theirs, and trees draw
        the SLOTS slots that rows were dealt to instead of rows.
        """
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        self.cuts = [_cuts(x[:, j], weight) for j in range(x.shape[1])]
        codes = self._codes(x)
        weight = np.ones(len(y)) if weight is None else weight
        self.base = float(y.sum() / weight.sum()) if slot is not None else float(y.mean())
        value = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(s.trees):
            drawn = rng.random(len(y) if slot is None else SLOTS) < s.row_share
            rows = np.flatnonzero(drawn if slot is None else drawn[slot])
            columns = np.sort(rng.permutation(x.shape[1])[: max(1, int(s.column_share * x.shape[1]))])
            tree = self._grow(codes[rows], y[rows] - weight[rows] * value[rows], weight[rows], columns)
            value += _leaves(tree, codes, s.depth)
            self.trees.append(tree)
        return self

    def _grow(self, codes: np.ndarray, rest: np.ndarray, weight: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full binary tree in heap order: feature and last left code of every inner node, value of every leaf.

        A node that no split improves sends all its rows to the left.
        """
        s, width = self.settings, CUTS + 1
        feature = np.zeros((1 << s.depth) - 1, np.int64)
        last_left = np.full((1 << s.depth) - 1, CUTS, np.int64)
        node = np.zeros(len(rest), np.int64)
        for level in range(s.depth):
            first, nodes = (1 << level) - 1, 1 << level
            best = np.full(nodes, 1e-12)
            for j in columns:
                at = node * width + codes[:, j]
                total = np.bincount(at, rest, nodes * width).reshape(nodes, width).cumsum(axis=1)
                count = np.bincount(at, weight, nodes * width).reshape(nodes, width).cumsum(axis=1)
                whole, n = total[:, -1:], count[:, -1:]
                gain = total**2 / (count + s.penalty) + (whole - total) ** 2 / (n - count + s.penalty) - whole**2 / (n + s.penalty)
                gain[(count < s.least_rows) | (n - count < s.least_rows)] = -1.0
                place = gain.argmax(axis=1)
                found = gain[np.arange(nodes), place]
                better = found > best
                best[better] = found[better]
                feature[first : first + nodes][better] = j
                last_left[first : first + nodes][better] = place[better]
            node = 2 * node + (codes[np.arange(len(rest)), feature[first + node]] > last_left[first + node])
        leaves = 1 << s.depth
        value = s.rate * np.bincount(node, rest, leaves) / (np.bincount(node, weight, leaves) + s.penalty)
        return feature, last_left, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return self.base + sum((_leaves(t, codes, self.settings.depth) for t in self.trees), np.zeros(len(x)))


def _cuts(values: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) > CUTS + 1:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="inverted_cdf", weights=weight))
    return (distinct[:-1] + distinct[1:]) / 2


def _leaves(tree: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, depth: int) -> np.ndarray:
    feature, last_left, value = tree
    node = np.zeros(len(codes), np.int64)
    rows = np.arange(len(codes))
    for level in range(depth):
        here = node + (1 << level) - 1
        node = 2 * node + (codes[rows, feature[here]] > last_left[here])
    return value[node]
