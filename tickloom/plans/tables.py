"""How the given tables are read as market data.  Every query starts from one of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import rnd, sdiv
from ..operators import indicators as ind
from ..sources import bars as B


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column, so results do not depend on summation order."""
    return df.select(*[rnd(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# order of trades inside a day: order, line, part, price to four places (digits of each)
def _tie() -> tuple:
    return ((F.col("l_orderkey"), 13), (F.col("l_linenumber"), 3), (F.col("l_partkey"), 11), (F.round(F.col("l_extendedprice") / F.col("l_quantity") * 10000), 11))


def _bars(lines: DataFrame, symbol: Column) -> DataFrame:
    return B.to_bars(
        lines,
        symbol=symbol,
        date=F.col("l_shipdate"),
        price=sdiv(F.col("l_extendedprice"), F.col("l_quantity")),
        qty=F.col("l_quantity"),
        amount=F.col("l_extendedprice"),
        tie=B.packed(*_tie()),
        extra={"deliv_pct": F.avg(F.col("l_discount") * 100.0 * 5)},
    )


def supplier_bars(spark: SparkSession, d: str) -> DataFrame:
    """Symbol = supplier; one bar per ship date.  The number of symbols grows with the data."""
    return _bars(table(spark, d, "lineitem"), F.col("l_suppkey").cast("string"))


def latest_supplier_bars(spark: SparkSession, d: str) -> DataFrame:
    """The bars of the newest day, from the trades of that day alone."""
    return _bars(B.latest_partition(table(spark, d, "lineitem"), "l_shipdate"), F.col("l_suppkey").cast("string"))


def segment_bars(spark: SparkSession, d: str) -> DataFrame:
    """Symbol = return flag + line status (6 of them); real intraday ranges."""
    return _bars(table(spark, d, "lineitem"), F.concat("l_returnflag", "l_linestatus"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Symbol master: one row per supplier with nation (industry) and region (sector)."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").cast("string").alias("symbol"),
            F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("acctbal"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("sector"),
        )
    )


def nation_bars(spark: SparkSession, d: str) -> DataFrame:
    """Symbol = supplier nation (25 at any scale)."""
    m = suppliers(spark, d).select(F.col("symbol").cast("long").alias("l_suppkey"), "nation")
    return _bars(table(spark, d, "lineitem").join(m, "l_suppkey"), F.col("nation"))


def index_close(bars: DataFrame) -> DataFrame:
    """Benchmark series: mean close over all symbols per date.  One row per calendar day."""
    return bars.groupBy("date").agg(F.avg("close").alias("bench"))


def supplier_panel(spark: SparkSession, d: str) -> DataFrame:
    return ind.indicators(supplier_bars(spark, d))


def segment_panel(spark: SparkSession, d: str) -> DataFrame:
    return ind.indicators(segment_bars(spark, d))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events as ticks: symbol = user, price = value, ordered by (ts, event_id)."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        "event_type",
        "props",
    )
