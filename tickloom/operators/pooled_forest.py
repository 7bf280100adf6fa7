"""A random forest over the rows of all symbols, grown level by level.

Rows are kept as one byte for each feature (their bins). Tasks add up the histograms of all trees over their rows, Spark
adds those of the tasks by tree, and a tree's next level is picked from its sums; only the grown levels, a few thousand
numbers, reach the driver. A row's weight in a tree is drawn from its key, so nothing is kept for each row and tree, and the
forest does not depend on how the rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

BINS, CUT_ROWS, SLICE = 32, 100_000, 1 << 15
#: Weights: how often one of n rows is drawn in n draws is Poisson(1); one of 2^16 equally likely places each.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
Level = tuple[np.ndarray, np.ndarray]  # feature and last bin on the left of every (tree, node); a node that is not parted goes left


def cuts_of(t: DataFrame, features: list[str], key: Column, n: int) -> list[np.ndarray]:
    """Upper ends of up to ``BINS`` - 1 bins of each feature: exact quantiles of all rows, or of about ``CUT_ROWS`` drawn by key."""
    some = t if n <= CUT_ROWS else t.where(F.abs(key % (1 << 40)) < int(CUT_ROWS / n * (1 << 40)))
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    found = some.agg(*[F.percentile(F.col(f).cast("double"), at).alias(f"_{k}") for k, f in enumerate(features)]).first()
    return [np.unique(x) if x else np.zeros(0) for x in found]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(feature, row): bins of x (row, feature)."""
    return np.stack([np.searchsorted(k, v).astype(np.uint8) for k, v in zip(cuts, x.T, strict=True)])


def weights(key: np.ndarray, trees: int, seed: int) -> Iterator[np.ndarray]:
    """For each tree the weights of the rows with these keys."""
    for k in range(0, trees, 4):
        with np.errstate(over="ignore"):
            h = key.view(np.uint64) + np.uint64((seed * 1_000_003 + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        part = (h ^ (h >> np.uint64(31))).view(np.uint16).reshape(-1, 4)
        for j in range(min(4, trees - k)):
            yield _POISSON[part[:, j]]


def _node(flat: np.ndarray, n: int, rows: np.ndarray, levels: list[Level], tree: int) -> np.ndarray:
    """Node of each of the rows below the grown levels; flat holds the bins of n rows, feature after feature."""
    node = np.zeros(len(rows), np.intp)
    for feature, cut in levels:
        at = (feature[tree] * n).take(node)
        at += rows
        right = flat.take(at) > cut[tree].take(node)
        node += node
        node += right
    return node


def _turns(trees: int, width: int, m: int, seed: int, level: int) -> np.ndarray:
    """(tree, node, k): the features that a node looks at, sqrt(m) rounded up."""
    return np.random.default_rng([seed, level]).random((trees, width, m)).argsort(axis=2)[:, :, : math.ceil(math.sqrt(m))]


def _best(h: np.ndarray, looked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tree's sums h (node, k, bin, target): feature and cut of each node by the Gini impurity, (node, side, target)."""
    left = h.cumsum(axis=2)
    right = left[:, :, -1:] - left
    gini = lambda s: s[..., 0] * s[..., 1] / np.maximum(s.sum(axis=3), 1)
    inside = (left.sum(axis=3) > 0) & (right.sum(axis=3) > 0)
    score = np.where(inside, gini(left) + gini(right), np.inf).reshape(len(h), -1)
    at, nodes = score.argmin(axis=1), np.arange(len(h))
    k, cut = at // BINS, at % BINS
    whole = h[:, 0].sum(axis=1)  # (node, target)
    parted = np.isfinite(score[nodes, at]) & (whole > 0).all(axis=1)
    sides = np.stack((left[nodes, k, cut], right[nodes, k, cut]), axis=1)
    sides[~parted] = np.stack((whole, np.zeros_like(whole)), axis=1)[~parted]
    return np.where(parted, looked[nodes, k], 0), np.where(parted, cut, BINS).astype(np.uint8), sides


def merged(counts: np.ndarray) -> np.ndarray:
    """counts (tree, leaf, target) with those of their common node for leaves below it that all vote alike, as ``pyspark.ml`` does."""
    node, out, whole = counts, counts, np.ones(counts.shape[:2], bool)
    for _ in range(counts.shape[1].bit_length() - 1):
        vote, none = node[..., 1] > node[..., 0], node.sum(axis=2) == 0
        alike = (vote[:, 0::2] == vote[:, 1::2]) | none[:, 0::2] | none[:, 1::2]
        node, whole = node[:, 0::2] + node[:, 1::2], alike & whole[:, 0::2] & whole[:, 1::2]
        below = out.reshape(*node.shape[:2], -1, 2)
        out = np.where(whole[:, :, None, None], node[:, :, None], below).reshape(counts.shape)
    return out


class Forest:
    """Cuts, levels and the leaves' shares of ones."""

    def __init__(self, cuts: list[np.ndarray], levels: list[Level], share: np.ndarray) -> None:
        self.cuts, self.levels, self.share = cuts, levels, share

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones over the trees."""
        total, b = np.zeros(len(x)), binned(x, self.cuts)
        for first in range(0, len(x), SLICE):
            flat = b[:, first : first + SLICE].ravel()
            rows = np.arange(len(flat) // len(b))
            for tree in range(len(self.share)):
                total[first : first + SLICE] += self.share[tree][_node(flat, len(rows), rows, self.levels, tree)]
        return total / len(self.share)


def grow(t: DataFrame, features: list[str], target: str, key: Column, trees: int, depth: int, seed: int) -> Forest | None:
    """A forest, at least one level deep, of the rows of t with their target, 0 or 1; None without rows. ``key`` is a long, different for different rows."""
    n, m = t.count(), len(features)
    if not n:
        return None
    cuts = cuts_of(t, features, key, n)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = binned(np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1), cuts)
            cells = [batch.column("_key"), batch.column("_y"), *map(pa.array, b.astype(np.int8))]
            yield pa.RecordBatch.from_arrays(cells, ["_key", "_y", *(f"_b{k}" for k in range(m))])

    raw = t.select(key.alias("_key"), F.col(target).cast("tinyint").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    rows = written(raw.mapInArrow(bins, "_key long, _y byte, " + ", ".join(f"_b{k} byte" for k in range(m))))
    levels: list[Level] = []
    for level in range(depth):
        width = 1 << level
        turns = _turns(trees, width, m, seed, level)
        some = turns.shape[2]
        grown = t.sparkSession.sparkContext.broadcast((levels, turns))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # collected in the same turn of the loop
            before, looked = grown.value
            h, starts = np.zeros((trees, width, some, BINS * 2)), np.arange(width) * BINS * 2
            for batch in batches:
                for first in range(0, batch.num_rows, SLICE):
                    part = batch.slice(first, SLICE)
                    ids, y, *b = (part.column(k).to_numpy(zero_copy_only=False) for k in range(m + 2))
                    flat, n = np.concatenate(b).view(np.uint8), part.num_rows
                    cell = 2 * flat.astype(np.int16) + np.tile(y, m)  # bin and target
                    for tree, w in enumerate(weights(np.ascontiguousarray(ids), trees, seed)):
                        drawn = np.flatnonzero(w)
                        node, weight = _node(flat, n, drawn, before, tree), w.take(drawn).astype(float)
                        for k in range(some):
                            at = (looked[tree, :, k] * n).take(node)
                            at += drawn
                            key = cell.take(at) + starts.take(node)
                            h[tree, :, k] += np.bincount(key, weight, width * BINS * 2).reshape(width, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees)), pa.array([x.tobytes() for x in h], pa.binary())], ["tree", "h"])

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, h = int(pdf["tree"].iloc[0]), sum(np.frombuffer(x) for x in pdf["h"])
            feature, cut, ends = _best(h.reshape(width, some, BINS, 2), grown.value[1][tree])
            return pd.DataFrame({"tree": [tree], "feature": [feature.tolist()], "cut": [cut.tolist()], "sides": [ends.ravel().tolist()]})

        added = rows.mapInArrow(sums, "tree long, h binary").groupBy("tree")
        got = sorted(added.applyInPandas(pick, "tree long, feature array<int>, cut array<int>, sides array<double>").collect(), key=lambda r: r.tree)
        levels = [*levels, (np.array([r.feature for r in got]), np.array([r.cut for r in got], np.uint8))]
        sides = np.array([r.sides for r in got]).reshape(trees, width, 2, 2)
    counts = merged(sides.reshape(trees, 1 << depth, 2))
    return Forest(cuts, levels, counts[..., 1] / np.maximum(counts.sum(axis=2), 1))
