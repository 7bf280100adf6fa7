"""Connected components in two shuffles a round: streamed star contractions over edges that tasks have contracted before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.components import HELD, least_labels
from llm.store import written

EDGE = "a long, b long"


def _edge_row(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _stars(rows: Iterator[tuple[np.ndarray, np.ndarray]], small: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From edges sorted by (a, b): the neighbours of each a hung on its least one or itself. The large star hangs the
    neighbours above a, the small star those below it and a itself. A node's first neighbour is its least, so a node with
    any number of them needs no memory."""
    node, low = None, None
    for a, b in rows:
        begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        least = np.minimum(a[begin], b[begin])
        if node is not None and a[0] == node:
            least[0] = low
        node, low = a[-1], least[-1]
        m = np.repeat(least, np.diff(np.append(begin, len(a))))
        child = b if small else np.where(b > a, b, a)
        keep = child > m
        yield child[keep], m[keep]
        if small:
            yield a[begin][a[begin] > least], least[a[begin] > least]


def _starred(small: bool, contract: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if x.num_rows)
        held, n = [], 0
        for a, b in _stars(rows, small):
            held.append((a, b))
            n += len(a)
            if n >= HELD:
                yield _drained(held, contract)
                held, n = [], 0
        if n:
            yield _drained(held, contract)

    return run


def _drained(held: list[tuple[np.ndarray, np.ndarray]], contract: bool) -> pa.RecordBatch:
    a, b = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    return _edge_row(*(least_labels(a, b) if contract else (a, b)))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for x in batches:
        if x.num_rows:
            held.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
            n += x.num_rows
        if n >= HELD:
            yield _drained(held, True)
            held, n = [], 0
    if n:
        yield _drained(held, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), as ``llm.components.components``; root is the least node.

    A round is two shuffles, each streamed through tasks sorted by node, and one written table. It ends when no node is
    hung twice, or hung and a root.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    now = written(ends.mapInArrow(_contracted, EDGE))
    while True:
        roles = now.select(F.col("a").alias("node"), F.col("b").alias("on")).union(now.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("on")))
        roles = roles.groupBy("node").agg(F.min("on").alias("lo"), F.max("on").alias("hi"), F.max(F.col("on").isNull()).alias("root"))
        if not roles.where("lo != hi OR (root AND lo IS NOT NULL)").limit(1).count():
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_starred(False, False), EDGE)
        now = written(large.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_starred(True, True), EDGE))
    return now.distinct().select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
