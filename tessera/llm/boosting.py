"""Gradient-boosted trees of depth two over small whole-number features, fitted on a table of counts.

The table holds each combination of features and label once, with its number of rows: it is bounded by the features'
ranges, however many rows there are. The fitted model is a Spark expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """Rows with feature <= cut go low, others high; a leaf has feature -1."""

    feature: int
    cut: int
    value: float
    low: "Node | None" = None
    high: "Node | None" = None

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.of(x), self.high.of(x))

    def column(self, features: Sequence[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(features[self.feature] <= self.cut, self.low.column(features)).otherwise(self.high.column(features))


def _grow(x: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, depth: int, rate: float, ridge: float = 1.0) -> Node:
    total_g, total_h = gradient.sum(), curvature.sum()
    best = (1e-6, -1, 0)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in values[:-1]:
                low = x[:, f] <= cut
                g, h = gradient[low].sum(), curvature[low].sum()
                gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                if gain > best[0]:
                    best = (gain, f, int(cut))
    if best[1] < 0:
        return Node(-1, 0, float(rate * total_g / (total_h + ridge)))
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], 0.0, _grow(x[low], gradient[low], curvature[low], depth - 1, rate), _grow(x[~low], gradient[~low], curvature[~low], depth - 1, rate))


@dataclass(frozen=True)
class Boosted:
    """The log-odds are start plus the trees' values; least has the calibrated threshold on them of each kind, the first feature."""

    start: float
    trees: tuple[Node, ...]
    least: dict[int, float]

    def score(self, features: Sequence[Column]) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column(features)
        return total


def fit(x: np.ndarray, label: np.ndarray, rows: np.ndarray, check: np.ndarray, precision: float, trees: int = 40, rate: float = 0.3) -> Boosted:
    """x: feature combinations; label 0 or 1; rows: how many; check: those (held out) that calibrate the threshold.

    A kind's threshold is the least score whose calibrated chance of label 1 is `precision` or more; a kind without
    such a score has none. Without rows of both labels nothing passes.
    """
    own, held = ~check, check
    weight = rows * own
    if not (weight[label == 1].sum() and weight[label == 0].sum() and rows[held & (label == 1)].sum()):
        return Boosted(0.0, (), {})
    start = float(np.log(weight[label == 1].sum() / weight[label == 0].sum()))
    score, made = np.full(len(x), start), []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        tree = _grow(x[own], ((label - chance) * weight)[own], (chance * (1 - chance) * weight)[own], 2, rate)
        made.append(tree)
        score = score + tree.of(x)
    least = {int(kind): found for kind in np.unique(x[:, 0]) if (found := _threshold(score, label, rows, held & (x[:, 0] == kind), precision)) is not None}
    return Boosted(start, tuple(made), least)


def _threshold(score: np.ndarray, label: np.ndarray, rows: np.ndarray, held: np.ndarray, precision: float) -> float | None:
    """The least score at which the held-out share of label 1, made never to fall with the score (pooled neighbours), will do."""
    pools: list[list[float]] = []
    s, good, n = score[held], (rows * label)[held], rows[held]
    for value in np.unique(s):
        pools.append([float(value), float(good[s == value].sum()), float(n[s == value].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, g, m = pools.pop()
            pools[-1][1] += g
            pools[-1][2] += m
    passing = [v for v, g, m in pools if g >= precision * m]
    return min(passing) - 1e-9 if passing else None  # sums in another order may differ in the last place
