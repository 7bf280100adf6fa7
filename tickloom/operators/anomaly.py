"""Isolation-forest anomalies.

Each tree draws its own few hundred rows from all rows and is grown in a task; the
forest, of a size that does not depend on the data, is broadcast and every row is
scored once, in parallel.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

SLICE = 1 << 13  # rows that go down the trees together


def _c(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> tuple:
    """(feature, cut, left, right) or (size,)."""
    spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
    if depth >= limit or len(x) <= 1 or not (spread > 0).any():
        return (len(x),)
    f = int(rng.choice(np.flatnonzero(spread > 0)))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    m = x[:, f] < cut
    return (f, cut, _grow(x[m], rng, depth + 1, limit), _grow(x[~m], rng, depth + 1, limit))


def _levels(tree: tuple) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(feature, cut) of the nodes of each level of a tree, and the path length of its leaves; a leaf fills the levels below it."""
    levels, now = [], [(tree, 0)]
    while any(len(t) > 1 for t, _ in now):
        levels.append((np.array([t[0] if len(t) > 1 else 0 for t, _ in now]), np.array([t[1] if len(t) > 1 else 0.0 for t, _ in now])))
        now = [x for t, d in now for x in (((t[2], d + 1), (t[3], d + 1)) if len(t) > 1 else ((t, d), (t, d)))]
    return levels, np.array([d + _c(t[0]) for t, d in now])


def _depths(levels: list[tuple[np.ndarray, np.ndarray]], length: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Path length of each of the rows, all of them a level at a time; x holds their values, feature after feature."""
    node = np.zeros(len(rows), np.intp)
    for feature, cut in levels:
        at = (feature * len(rows)).take(node)
        at += rows
        right = ~(x.take(at) < cut.take(node))
        node += node
        node += right
    return length.take(node)


def _forest(df: DataFrame, features: list[str], trees: int, sample: int, seed: int) -> list[tuple]:
    """One tree for each group of rows; a row is drawn for a tree by a hash of the row and the tree's number.

    The hashes are generated code over one row for each tree, not a lambda over an array of trees."""
    n = df.count()
    if not n:
        return []
    keyed = df.select(*[F.col(f).cast("double") for f in features], *[F.col(f"`{x}`").alias(f"_r{i}") for i, x in enumerate(df.columns)])
    # about twice the rows wanted pass the threshold, of which the least hashes are taken
    share = min(1.0, 2.0 * sample / n + 20.0 / n)
    draw = F.xxhash64(F.lit(seed), "tree", *[f"_r{i}" for i in range(len(df.columns))]) / 2.0**64 + 0.5
    drawn = keyed.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).filter(draw <= share)
    place = F.row_number().over(W.partitionBy("tree").orderBy(draw, *features))
    drawn = drawn.withColumn("_n", place).filter(F.col("_n") <= sample).select("tree", *features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[features].to_numpy(float)
        x = x[np.lexsort(x.T)]
        k = int(pdf["tree"].iloc[0])
        tree = _grow(x, np.random.default_rng([seed, k]), 0, math.ceil(math.log2(max(len(x), 2))))
        return pd.DataFrame({"tree": [k], "grown": [pickle.dumps((len(x), tree))]})

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree long, grown binary").collect()  # one row per tree
    return [pickle.loads(r.grown) for r in sorted(grown, key=lambda r: r.tree)]


def exact_cut(scored: DataFrame, share: float, bins: int = 1 << 16) -> float | None:
    """The ``share`` quantile of column score (between -1 and 0), with linear interpolation.

    Counts by equal bins say which bins hold the two order statistics around it; only the distinct scores of those bins
    are looked at."""
    at = F.floor((F.col("score") + 1) * bins).alias("bin")
    counts = scored.groupBy(at).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # at most ``bins`` rows
    n = sum(r.n for r in counts)
    if not n:
        return None
    low = math.floor(share * (n - 1))
    found, before, need = {}, 0, [low, min(low + 1, n - 1)]
    for r in counts:
        inside = [k for k in need if before <= k < before + r.n]
        if inside:
            values = scored.filter(at == r.bin).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy("score")
            upto = F.sum("n").over(W.orderBy("score").rowsBetween(W.unboundedPreceding, 0))
            for k in inside:
                found[k] = values.withColumn("_u", upto).filter(F.col("_u") > k - before).agg(F.min("score")).first()[0]
        before += r.n
    return found[need[0]] + (share * (n - 1) - low) * (found[need[1]] - found[need[0]])


def isolation_anomalies(df: DataFrame, features: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.01, seed: int = 42) -> DataFrame:
    """Rows whose score lies below the exact ``contamination`` quantile of all scores; lower is stranger.

    Rows are counted, drawn and scored: df is written first, and so are the scores."""
    df = written(df)
    grown = _forest(df, features, trees, sample, seed)
    forest = df.sparkSession.sparkContext.broadcast([_levels(t) for _, t in grown])
    norm = sum((_c(n) for n, _ in grown), 0.0)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        total, x = [], np.stack([s.to_numpy(float) for s in cols])
        for first in range(0, x.shape[1], SLICE):
            part = x[:, first : first + SLICE]
            flat, rows, out = part.ravel(), np.arange(part.shape[1]), np.zeros(part.shape[1])
            for levels, length in forest.value:
                out += _depths(levels, length, flat, rows)
            total.append(out)
        return pd.Series(-np.exp2(-np.concatenate(total) / norm) if norm else np.zeros(x.shape[1]))

    scored = written(df.withColumn("score", score(*features)))
    cut = exact_cut(scored, contamination)
    return scored.filter(F.col("score") < F.lit(cut)).orderBy("score")
