"""Window primitives over (symbol, date) keyed tables.

All of them share one ordering, so a chain of operators needs one shuffle by
symbol and one sort.  A symbol never has more rows than the calendar has days:
``sources.bars`` reduces raw trades to one row per (symbol, date) with map-side
partial aggregation first, which is what keeps a hot symbol (say a third of all
trades) from becoming a hot window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .num import sdiv


def by_symbol(key: str = "symbol", order: str = "date") -> WindowSpec:
    return W.partitionBy(key).orderBy(order)


def back(n: int, key: str = "symbol", order: str = "date") -> WindowSpec:
    """Frame of the current row and the n-1 rows before it."""
    return by_symbol(key, order).rowsBetween(-(n - 1), 0)


def sofar(key: str = "symbol", order: str = "date") -> WindowSpec:
    return by_symbol(key, order).rowsBetween(W.unboundedPreceding, 0)


def whole(key: str = "symbol") -> WindowSpec:
    return W.partitionBy(key)


def throughout(key: str = "symbol", order: str = "date") -> WindowSpec:
    """All rows of the symbol, as a frame on the shared order."""
    return by_symbol(key, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def full(agg: Column, x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """``agg`` over the last n rows, NULL until n non-null values are present."""
    w = w or back(n)
    return F.when(F.count(x).over(w) == n, agg.over(w))


def mean(x: Column, n: int) -> Column:
    return full(F.avg(x), x, n)


def std(x: Column, n: int) -> Column:
    return full(F.stddev_samp(x), x, n)


def std_pop(x: Column, n: int) -> Column:
    return full(F.stddev_pop(x), x, n)


def total(x: Column, n: int) -> Column:
    return full(F.sum(x), x, n)


def lowest(x: Column, n: int) -> Column:
    return full(F.min(x), x, n)


def highest(x: Column, n: int) -> Column:
    return full(F.max(x), x, n)


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_symbol())


def diff(x: Column, n: int = 1) -> Column:
    return x - lag(x, n)


def pct_change(x: Column, n: int = 1) -> Column:
    return sdiv(x, lag(x, n)) - 1


def log_return(x: Column, n: int = 1) -> Column:
    """ln(x / lag x); NULL when either price is not positive."""
    prev = lag(x, n)
    return F.when((x > 0) & (prev > 0), F.log(x / prev))


def ffill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(sofar())


def expanding_mean(x: Column) -> Column:
    return F.avg(x).over(sofar())


def cum_max(x: Column) -> Column:
    return F.max(x).over(sofar())


def cum_prod1p(r: Column) -> Column:
    """Running product of (1 + r) for r > -1."""
    return F.exp(F.sum(F.log1p(r)).over(sofar()))


def centred_max(x: Column, n: int = 5) -> Column:
    h = n // 2
    w = by_symbol().rowsBetween(-h, h)
    return full(F.max(x), x, n, w)


def bar_no() -> Column:
    """0-based position of the bar within its symbol."""
    return F.row_number().over(by_symbol()) - 1


def position(df: DataFrame) -> DataFrame:
    """Add ``bn`` (0-based bar number) and ``n_bars`` of the symbol, unless present."""
    if "bn" in df.columns:
        return df
    # the count runs on the same order, so both are one window operator
    return df.withColumns({"bn": bar_no(), "n_bars": F.count(F.lit(1)).over(throughout())})


def age() -> Column:
    """Bars from the end (0 = last bar) of a positioned frame."""
    return F.col("n_bars") - 1 - F.col("bn")


def from_end() -> Column:
    """0 for the last bar of a symbol, 1 for the one before, ...; shares the ascending sort."""
    return F.count(F.lit(1)).over(whole()) - F.row_number().over(by_symbol())


def tail(df: DataFrame, n: int) -> DataFrame:
    """Last n bars of each symbol."""
    return df.withColumn("_fe", from_end()).filter(F.col("_fe") < n).drop("_fe")


def latest(df: DataFrame) -> DataFrame:
    """Last bar of each symbol.  ``lead is null`` reuses the ascending sort of the other windows."""
    return df.withColumn("_nx", F.lead("date").over(by_symbol())).filter("_nx is null").drop("_nx")


def streak(cond: Column) -> Column:
    """Length of the run of true values ending at the current row; needs a 1-based ``_rn`` column."""
    # position of the last non-true row so far; rows before it do not count
    broke = F.max(F.when(~F.coalesce(cond, F.lit(False)), F.col("_rn"))).over(sofar())
    return F.col("_rn") - F.coalesce(broke, F.lit(0))


def with_streak(df: DataFrame, cond: Column, name: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(by_symbol())).withColumn(name, streak(cond)).drop("_rn")


def linreg_end(df: DataFrame, y: str, n: int, out: str) -> DataFrame:
    """End point of the least-squares line through the last n values of ``y``.

    The line through (0, y0) .. (n-1, yn-1) ends at ybar + slope * (n-1)/2, and
    the slope needs only sum(y) and sum(i*y); with the global bar number i, the
    shift to a window-local index is algebra, so two rolling sums suffice.
    """
    i = F.col("_bn")
    v = F.col(y)
    t = df.withColumn("_bn", bar_no().cast("double")).withColumn("_iy", F.col("_bn") * v)
    s, sxy = total(v, n), total(F.col("_iy"), n)
    t = t.withColumn("_s", s).withColumn("_sxy", sxy)
    # local index = i_row - (i - n + 1)
    local = F.col("_sxy") - (i - (n - 1)) * F.col("_s")
    sx, sxx = n * (n - 1) / 2.0, n * (n - 1) * (2 * n - 1) / 6.0
    slope = (n * local - sx * F.col("_s")) / (n * sxx - sx * sx)
    return t.withColumn(out, F.col("_s") / n + slope * ((n - 1) / 2.0)).drop("_bn", "_iy", "_s", "_sxy")
