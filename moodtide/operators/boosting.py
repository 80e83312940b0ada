"""Boosted regression trees over one matrix that fits a task: squared error, second-order gain, shrinkage.

A missing value (NaN) has no place in the order of a feature; every split learns the side that missing values take. A task
fits one candidate of a search with it (``learn.train_forecaster``), so that the search is one Spark job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Distinct places of a feature at most, weight of the penalty on leaf values, least gain of a split, value before the first tree.
BINS, PENALTY, LEAST_GAIN, START = 256, 1.0, 1e-9, 0.5


@dataclass
class Tree:
    """Nodes in an array: ``feature`` is -1 at a leaf; a row goes left if its value is at most ``threshold``."""

    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.feature[node] >= 0)
        while len(inner):
            at = node[inner]
            values = x[inner, self.feature[at]]
            with np.errstate(invalid="ignore"):
                goes_left = np.where(np.isnan(values), self.missing_left[at], values <= self.threshold[at])
            node[inner] = self.left[at] + ~goes_left  # the right child stands behind the left one
            inner = inner[self.feature[node[inner]] >= 0]
        return self.value[node]


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """The upper ends of each feature's places: its distinct values, or as many of its quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column[~np.isnan(column)])
        if len(values) > bins:
            values = np.unique(np.quantile(column[~np.isnan(column)], np.linspace(0, 1, bins + 1)[1:], method="inverted_cdf"))
        out.append(values)
    return out


class Matrix:
    """A training matrix as places in its features' edges, with the order of the rows by each feature."""

    def __init__(self, x: np.ndarray, bins: int = BINS):
        self.edges = edges(x, bins)
        self.codes = np.empty(x.shape[::-1], np.int16)  # one row a feature
        for f, column in enumerate(x.T):
            code = np.searchsorted(self.edges[f], column)
            self.codes[f] = np.where(np.isnan(column), len(self.edges[f]), code)
        self.gaps = np.array([len(e) for e in self.edges], np.int16)  # the code of a missing value
        self.gappy = np.flatnonzero((self.codes == self.gaps[:, None]).any(axis=1))
        self.order = np.argsort(self.codes, axis=1, kind="stable")
        self.begin = np.arange(len(self.codes))[:, None] * self.codes.shape[1]  # of each feature in the codes laid out flat


def _gains(sums: np.ndarray, counts: np.ndarray, all_sums: np.ndarray, all_counts: np.ndarray) -> np.ndarray:
    """What splitting off a part with these sums of gradients and counts gains, before what the whole has is taken off."""
    rest = all_sums - sums
    rest *= rest
    rest /= np.maximum(all_counts - counts, 0) + PENALTY
    gains = sums * sums
    gains /= counts + PENALTY
    gains += rest
    return gains


def grow(matrix: Matrix, gradient: np.ndarray, depth: int, step: float) -> tuple[Tree, np.ndarray]:
    """One tree for the gradients, level by level, and its value for every training row."""
    features, rows = matrix.codes.shape
    node = np.zeros(rows, np.int16)  # number among the open nodes of the level, -1 in a leaf
    place = np.zeros(1, np.int64)  # of each open node in the tree
    at = matrix.order
    columns: list[list] = [[-1], [0.0], [False], [0], [0.0]]
    leaf = np.zeros(rows)
    every = np.arange(features)[:, None]
    flat = matrix.codes.ravel()
    for level in range(depth + 1):
        open_ = np.flatnonzero(node >= 0)
        if not len(open_):
            break
        totals = np.bincount(node[open_], gradient[open_], len(place))
        counts = np.bincount(node[open_], minlength=len(place))
        values = -step * totals / (counts + PENALTY)
        for p, value in zip(place.tolist(), values.tolist()):
            columns[4][p] = value
        leaf[open_] = values[node[open_]]
        if level == depth or len(open_) < 2:
            break
        # rows by node and, inside it, by feature: the nodes' ranges are the same for all features
        if level:
            order = np.argsort(node.take(at), axis=1, kind="stable")[:, at.shape[1] - len(open_) :]
            at = at.take(order + every * at.shape[1])
        starts = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(place)), counts)
        code = flat.take(at + matrix.begin)
        sums = gradient.take(at)
        sums[:, starts[1:]] -= totals[:-1]  # so that running sums begin anew with each node
        sums = np.cumsum(sums, axis=1)
        before = np.arange(len(open_)) - starts[of] + 1
        ends = np.ones(code.shape, bool)  # a split needs a next value in the same node
        ends[:, :-1] = (code[:, :-1] == code[:, 1:]) | (of[:-1] != of[1:])
        gains = _gains(sums, before, totals[of], counts[of])
        sides = np.zeros(code.shape, bool)
        if len(matrix.gappy):
            some = matrix.gappy
            gap = code[some] == matrix.gaps[some, None]
            lost = np.add.reduceat(gap, starts, axis=1)[:, of]
            lost_sums = np.add.reduceat(np.where(gap, gradient.take(at[some]), 0.0), starts, axis=1)[:, of]
            ends[some] |= gap
            with_left = _gains(sums[some] + lost_sums, before + lost, totals[of], counts[of])
            with_left[before + lost >= counts[of]] = -np.inf  # nothing would be left on the right
            sides[some] = with_left > gains[some]
            gains[some] = np.maximum(with_left, gains[some])
        gains[ends] = -np.inf
        best = np.maximum.reduceat(gains, starts, axis=1)
        chosen = best.argmax(axis=0)
        most = best[chosen, np.arange(len(place))]
        splits = most - totals**2 / (counts + PENALTY) > LEAST_GAIN
        hit = np.flatnonzero(gains[chosen[of], np.arange(len(of))] == most[of])
        first = hit[np.unique(of[hit], return_index=True)[1]]  # of equal gains the lowest place

        after = np.full(len(place), -1, np.int16)  # number of each split node among them
        after[splits] = np.arange(int(splits.sum()))
        next_place = len(columns[0]) + 2 * np.arange(int(splits.sum()))
        split_feature, split_code = chosen, code[chosen, first]
        split_side = sides[chosen, first]
        for n in np.flatnonzero(splits).tolist():
            f = int(split_feature[n])
            p = int(place[n])
            columns[0][p], columns[1][p] = f, float(matrix.edges[f][split_code[n]])
            columns[2][p], columns[3][p] = bool(split_side[n]), len(columns[0])
            for column, empty in zip(columns, (-1, 0.0, False, 0, 0.0)):
                column += [empty, empty]
        mine = node[open_]
        own = matrix.codes[split_feature[mine], open_]
        goes_left = np.where(own == matrix.gaps[split_feature[mine]], split_side[mine], own <= split_code[mine])
        node[open_] = np.where(splits[mine], 2 * after[mine] + ~goes_left, -1)
        place = np.repeat(next_place, 2) + np.tile([0, 1], len(next_place))
    kinds = (np.int32, np.float64, bool, np.int32, np.float64)
    return Tree(*[np.array(c, k) for c, k in zip(columns, kinds)]), leaf


def boost(x: np.ndarray, y: np.ndarray, depth: int, step: float, trees: int, bins: int = BINS) -> Iterator[Tree]:
    """The trees of a boosting, one after another; a shorter boosting has the first ones."""
    matrix = Matrix(x, bins)
    fitted = np.full(len(y), START)
    for _ in range(trees):
        tree, leaf = grow(matrix, fitted - y, depth, step)
        fitted += leaf
        yield tree


def staged_scores(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, depth: int, step: float, after: list[int]) -> list[float]:
    """r2 on held rows after each of the given numbers of trees; 0 where the held values are all equal."""
    predicted = np.full(len(held_y), START)
    spread = held_y.var() if len(held_y) else 0.0
    scores = {}
    for n, tree in enumerate(boost(x, y, depth, step, max(after)), 1):
        predicted += tree.predict(held_x)
        if n in after:
            scores[n] = 1 - float(((predicted - held_y) ** 2).mean()) / spread if spread else 0.0
    return [scores[n] for n in after]
