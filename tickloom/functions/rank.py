"""Cross-sectional ranks that never put the whole universe into one task.

A window without partition keys sorts everything in a single task.  A rank only needs
how many rows lie beyond a value, so: count rows per distinct value (map-side
combined, which also absorbs a hot value), turn counts into ranks, and join the ranks
back by value.  Counts become ranks through buckets of the value range: rows before a
bucket come from a table with one row per bucket, rows before a value inside its
bucket from a window partitioned by the bucket.  The bucket function is a fixed
monotone map, so any data gives exact results; only the balance depends on it.

The value is a join key, so it must not depend on summation order: round a computed
average before ranking by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucket(v: Column) -> Column:
    """Monotone bucket number: 64 steps per doubling of |v| (relative width of about 1 %)."""
    return (F.signum(v) * F.floor(F.log2(1.0 + F.abs(v) * 1e6) * 64.0)).cast("int")


def value_ranks(df: DataFrame, value: str, within: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Distinct values with ``_before`` (rows strictly ahead), ``_ties`` (rows equal) and ``_all`` (rows ranked)."""
    keys = within or []
    v = F.col(value)
    counts = df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_ties")).withColumn("_b", _bucket(F.col("_v")))
    order = (lambda x: F.col(x).desc()) if descending else (lambda x: F.col(x).asc())
    per_bucket = counts.groupBy(*keys, "_b").agg(F.sum("_ties").alias("_nb"))
    wb = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    # at most 64 buckets per doubling: a few thousand rows per group at any data size
    offsets = per_bucket.select(
        *keys, "_b",
        (F.sum("_nb").over(wb.orderBy(order("_b")).rowsBetween(W.unboundedPreceding, 0)) - F.col("_nb")).alias("_off"),
        F.sum("_nb").over(wb).alias("_all"),
    )
    inside = W.partitionBy(*keys, "_b").orderBy(order("_v")).rowsBetween(W.unboundedPreceding, 0)
    j = counts.join(offsets, [*keys, "_b"])
    return j.select(*keys, "_v", "_ties", "_all", (F.col("_off") + F.sum("_ties").over(inside) - F.col("_ties")).alias("_before"))


def _attach(df: DataFrame, value: str, ranks: DataFrame, keys: list[str], out: Column, name: str) -> DataFrame:
    r = ranks.select(*keys, F.col("_v").alias(value), out.alias(name))
    return df.join(r, [*keys, value], "left").select(*df.columns, name)


def min_rank(df: DataFrame, value: str, name: str = "rank", within: list[str] | None = None, descending: bool = True) -> DataFrame:
    """Rank 1 = first; ties share the smallest rank; NULL values get no rank."""
    r = value_ranks(df, value, within, descending)
    return _attach(df, value, r, within or [], F.col("_before") + 1, name)


def percent_rank_avg(df: DataFrame, value: str, name: str, within: list[str] | None = None) -> DataFrame:
    """Average rank of the ties over the number of ranked rows, times 100."""
    r = value_ranks(df, value, within)
    pct = (F.col("_before") + 1 + (F.col("_ties") - 1) / 2.0) / F.col("_all") * 100.0
    return _attach(df, value, r, within or [], pct, name)
