"""One small random forest per symbol, all symbols in parallel.

A symbol's rows are as many as its bars, so a forest fits one task; Spark spreads the symbols. Trees are grown on bootstrap
samples, level by level and all together, with a random subset of features at each node and the Gini impurity of binned
features (exact for features of up to ``BINS`` values).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.num import c
from .learn import FEATURES

BINS = 64
OUT = "symbol string, date date, close double, target int, prediction int, probability double"


def bins_of(x: np.ndarray) -> list[np.ndarray]:
    """Up to ``BINS`` cut points of each feature, between values that occur."""
    out = []
    for v in x.T:
        values = np.unique(v)
        cuts = (values[1:] + values[:-1]) / 2
        out.append(cuts if len(cuts) < BINS else cuts[np.unique(np.linspace(0, len(cuts) - 1, BINS - 1).astype(int))])
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(k, v) for k, v in zip(cuts, x.T, strict=True)], axis=1)


class Forest:
    """All trees of a forest, grown together: one histogram of (node, feature in turn, bin) for each level.

    A node looks at a few features in random order at a time, at later ones only where the first do not part its rows: so
    only those are counted. A row drawn several times for a tree is one row with a weight. Bins are read where they lie,
    row after row, and a histogram has the nodes of a bin beside each other, so sums over bins run over all nodes at once.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int, depth: int, r: np.random.RandomState) -> None:
        n, m = x.shape
        self.cuts, self.depth = bins_of(x), depth
        rows = r.randint(0, n, (trees, n))
        b = binned(x, self.cuts).ravel()
        drawn = np.bincount((rows + np.arange(trees)[:, None] * n).ravel(), minlength=trees * n)
        drawn_at = np.flatnonzero(drawn)
        weight = drawn.take(drawn_at).astype(float)
        at, row = np.divmod(drawn_at, n)  # a row's node, those of a tree behind each other; at first its tree
        one, cell = y.astype(np.intp).take(row), row * m
        some = max(1, int(np.sqrt(m)))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(depth):
            width = 1 << level
            turns = r.rand(trees, width, m).argsort(axis=2).reshape(trees * width, m)
            feature, cut = np.full(trees * width, -1), np.zeros(trees * width, int)
            open_ = (self._counts(at, one, weight, trees * width) > 0).all(axis=0)
            for first in range(0, m, some):
                left = np.flatnonzero(open_)
                if not len(left):
                    break
                looked = np.sort(turns[left, first : first + some], axis=1)
                if len(left) < len(open_):
                    inside, place = np.flatnonzero(open_.take(at)), np.zeros(len(open_), np.intp)
                    place[left] = np.arange(len(left))
                    rest = place.take(at.take(inside)), *(v.take(inside) for v in (one, cell, weight))
                else:
                    rest = at, one, cell, weight
                best, k, parts = self._best(b, *rest, looked, float(n + 1) * (first // some))
                parted = left[parts]
                feature[parted], cut[parted] = best[parts], k[parts]
                open_[parted] = False
            self.levels.append((feature.reshape(trees, width), cut.reshape(trees, width)))
            at = self._down(b, at, cell, feature, cut)
        none, ones = self._counts(at, one, weight, trees << depth)
        self.share = (ones / np.maximum(none + ones, 1)).reshape(trees, 1 << depth)

    @staticmethod
    def _counts(at: np.ndarray, one: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
        """(target, node): rows."""
        return np.bincount(one * nodes + at, weight, 2 * nodes).reshape(2, nodes)

    @staticmethod
    def _best(b: np.ndarray, at: np.ndarray, one: np.ndarray, cell: np.ndarray, weight: np.ndarray, looked: np.ndarray, late: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each node the best feature looked at and its bin by the Gini impurity, and whether there is one."""
        nodes, some = looked.shape
        feature, cut, least = looked[:, 0].copy(), np.zeros(nodes, np.intp), np.full(nodes, np.inf)
        for k in range(some):
            key = b.take(cell + looked[:, k].take(at))
            key += one * BINS
            key *= nodes
            key += at
            left = np.bincount(key, weight, 2 * BINS * nodes).reshape(2, BINS, nodes)
            for i in range(1, BINS):
                left[:, i] += left[:, i - 1]
            right = left[:, -1:] - left
            n, rest = left[0] + left[1], right[0] + right[1]
            left[1] *= left[0]
            right[1] *= right[0]
            with np.errstate(invalid="ignore"):  # an empty side has 0 / 0
                score = np.divide(left[1], n, out=n)
                score += np.divide(right[1], rest, out=rest)
            score += late
            np.copyto(score, np.inf, where=np.isnan(score))
            first = score.argmin(axis=0)
            value = score[first, np.arange(nodes)]
            better = value < least
            feature[better], cut[better], least[better] = looked[better, k], first[better], value[better]
        return feature, cut, np.isfinite(least)

    @staticmethod
    def _down(b: np.ndarray, at: np.ndarray, cell: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Children of the nodes: 2 * node to the left; a node that is not parted goes left as a whole."""
        value = b.take(cell + np.maximum(feature, 0).take(at))
        return 2 * at + (value > np.where(feature >= 0, cut, BINS).take(at))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones over the trees."""
        trees = len(self.share)
        b, cell = binned(x, self.cuts).ravel(), np.tile(np.arange(len(x)) * x.shape[1], trees)
        at = np.repeat(np.arange(trees), len(x))
        for feature, cut in self.levels:
            at = self._down(b, at, cell, feature.ravel(), cut.ravel())
        return self.share.ravel().take(at).reshape(trees, len(x)).mean(axis=0)


def fit_predict_by_symbol(t: DataFrame, trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """A forest per symbol, fitted on its training rows, and its predictions for the rest (see ``learn.fit_predict``).

    A symbol's result depends on its own rows and the seed alone. Without training rows a symbol has no predictions; where
    all its training targets are equal they are its prediction.
    """

    def one(key, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("date").to_numpy())
        at = {f: rows.column(f).to_numpy()[order] for f in [*FEATURES, "target", "is_train"]}
        train = at["is_train"].astype(bool)
        if train.all() or not train.any():
            return empty
        x, y = np.column_stack([at[f] for f in FEATURES]).astype(float), at["target"].astype(float)
        r = np.random.RandomState((zlib.crc32(str(key[0].as_py()).encode()) ^ seed) & 0x7FFFFFFF)
        p = Forest(x[train], y[train], trees, depth, r).probability(x[~train])
        out = rows.select(["symbol", "date", "close", "target"]).take(pa.array(order[~train]))
        return out.append_column("prediction", pa.array(p > 0.5).cast(pa.int32())).append_column("probability", pa.array(p)).cast(schema)

    schema = pa.schema([("symbol", pa.string()), ("date", pa.date32()), ("close", pa.float64()), ("target", pa.int32()), ("prediction", pa.int32()), ("probability", pa.float64())])
    empty = schema.empty_table()
    cols = ["symbol", "date", "close", *FEATURES, "target", "is_train"]
    return t.select(*cols).filter(c.is_train.isNotNull()).groupBy("symbol").applyInArrow(lambda key, rows: one(key, rows), OUT)
