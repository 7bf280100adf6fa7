"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.store import written

HELD = 500_000  # edges that a task contracts at once


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of some edges that are not the least themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for hook in (x, y, label[x], label[y]):
            np.minimum.at(new, hook, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: the same components with fewer edges and no chains."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def stars() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = least_labels(t.column("a").to_numpy(), t.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node of its component.

    Each task first makes stars of the edges that it holds. Then each round hangs all larger neighbours of a node on the
    least one, then all smaller ones (a star each way); a node with very many neighbours is pre-aggregated before its
    minimum moves. Rounds grow with the logarithm of a component's size, and end when no node is both hung and a root.
    Every round is a written table. Null ends and loops link nothing.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    now = written(ends.mapInArrow(_contracted, "a long, b long").distinct())
    while True:
        # a forest of stars: each node is hung once, or is a root
        roles = now.select(F.col("a").alias("node"), F.lit(1).alias("hung")).union(now.select(F.col("b").alias("node"), F.lit(0).alias("hung")).distinct())
        if not roles.groupBy("node").agg(F.sum("hung").alias("hung"), F.count_if(F.col("hung") == 0).alias("root")).where("hung > 1 OR (hung = 1 AND root > 0)").limit(1).count():
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
