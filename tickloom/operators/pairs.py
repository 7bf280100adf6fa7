"""Date alignments and pair operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c


def with_delivery(bars: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Delivery percent of the bar's date, else of the last earlier bar that had one, else 0."""
    j = bars.join(deliveries.select("symbol", "date", "deliv_pct"), ["symbol", "date"], "left")
    return j.withColumn("deliv_pct", F.coalesce(ts.ffill(c.deliv_pct), F.lit(0.0)))


def with_benchmark(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Bars on the dates of the benchmark; the benchmark has one row per calendar day, hence broadcast."""
    return bars.filter(c.close.isNotNull()).join(F.broadcast(bench.filter("bench is not null")), "date")


def aligned_pairs(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Both closes of every pair of a given symbol list on their common dates.

    The closes of the list become one row per calendar day; its pairs are unfolded
    from that row, so neither a join nor a per-date group of all symbols is needed.
    """
    wide = bars.filter(c.symbol.isin(symbols)).groupBy("date").pivot("symbol", symbols).agg(F.max("close"))
    n = sorted(symbols)
    pairs = [
        F.struct(F.lit(a).alias("symbol_a"), F.lit(b).alias("symbol_b"), F.col(f"`{a}`").alias("close_a"), F.col(f"`{b}`").alias("close_b"))
        for i, a in enumerate(n) for b in n[i + 1 :]
    ]
    return wide.select("date", F.inline(F.array(*pairs))).filter("close_a is not null and close_b is not null").select("symbol_a", "symbol_b", "date", "close_a", "close_b")
