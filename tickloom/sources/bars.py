"""Daily bars: building them from trades, resampling, selecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume", "turnover"]


def _fold_bars(trades: DataFrame, keys: list[str], tie: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    # every aggregate has a fixed-width buffer, so Spark hashes on both sides of the shuffle
    # and never sorts the trades; a symbol with a third of them ships one row per (task, date)
    return trades.groupBy(*keys).agg(
        F.min_by("price", tie).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", tie).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum("amount").alias("turnover"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def to_bars(
    trades: DataFrame,
    symbol: Column,
    date: Column,
    price: Column,
    qty: Column,
    amount: Column,
    tie: Column,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Trades to one OHLCV row per (symbol, date); ``tie``, a number or timestamp, orders trades inside a day."""
    t = trades.select(
        "*",
        symbol.alias("symbol"),
        date.cast("date").alias("date"),
        price.alias("price"),
        qty.cast("double").alias("qty"),
        amount.alias("amount"),
        tie.alias("_tie"),
    )
    return _fold_bars(t, ["symbol", "date"], F.col("_tie"), extra)


def packed(*parts: tuple[Column, int]) -> Column:
    """Whole numbers of at most the given digits as one decimal of 38 digits, which orders like their tuple."""
    out = F.lit(0).cast("decimal(38,0)")
    for col, digits in parts:
        out = (out * F.lit(str(10**digits)).cast("decimal(38,0)") + col.cast("decimal(38,0)")).cast("decimal(38,0)")
    return out


def week_ending_friday(d: Column) -> Column:
    """The Friday on or after ``d``."""
    return F.date_add(d, F.pmod(F.lit(6) - F.dayofweek(d), F.lit(7)))


def resample(bars: DataFrame, every: str) -> DataFrame:
    """Daily bars to ``week`` (ending Friday) or ``month`` (ending on its last day) bars; empty buckets do not appear."""
    label = {"week": week_ending_friday(F.col("date")), "month": F.last_day("date")}[every]
    return (
        bars.withColumn("_b", label)
        .groupBy("symbol", F.col("_b").alias("bucket"))
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "date")
    )


def intraday_bars(ticks: DataFrame, every: str, ts_col: str = "ts", price: str = "price", qty: str | None = None) -> DataFrame:
    """Ticks to bars of a fixed width ('5 seconds' .. '4 hours').  Works on batch and streaming input."""
    q = F.col(qty) if qty else F.lit(1.0)
    ticks = ticks.withColumn("_tie", packed((F.unix_micros(ts_col), 18), (F.col("seq"), 19)))
    return (
        ticks.groupBy("symbol", F.window(ts_col, every).alias("w"))
        .agg(
            F.min_by(price, "_tie").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "_tie").alias("close"),
            F.sum(q).alias("volume"),
            F.count(F.lit(1)).alias("ticks"),
        )
        .select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "ticks")
    )


def prices(bars: DataFrame, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of one symbol and/or an inclusive date range, ordered by symbol and date."""
    if symbol is not None:
        bars = bars.filter(F.col("symbol") == symbol.strip().upper())
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    return bars.orderBy("symbol", "date")


def sql_over_prices(bars: DataFrame, text: str, args: dict | None = None, view: str = "prices") -> DataFrame:
    """Run SQL text with named parameters against the bars, visible as view ``prices``."""
    bars.createOrReplaceTempView(view)
    return bars.sparkSession.sql(text, args=args or {})


def latest_bars(bars: DataFrame) -> DataFrame:
    """Latest bar per symbol by aggregation: one partial row per symbol and task, no sort."""
    cols = [c for c in bars.columns if c not in ("symbol", "date")]
    return (
        bars.groupBy("symbol")
        .agg(F.max("date").alias("date"), F.max_by(F.struct(*cols), "date").alias("_r"))
        .select("symbol", "date", *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def keep_last(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row per key, the one with the greatest ``version`` (append-then-dedupe keep last)."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), version).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def keep_first(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), version).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def concat_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Concatenate history chunks, first chunk wins on a repeated (symbol, date); open interest is 0 where absent."""
    tagged = [c.withColumn("_chunk", F.lit(i)) for i, c in enumerate(chunks)]
    u = tagged[0]
    for c in tagged[1:]:
        u = u.unionByName(c, allowMissingColumns=True)
    if "oi" not in u.columns:
        u = u.withColumn("oi", F.lit(0.0))
    return keep_first(u, ["symbol", "date"], F.col("_chunk")).drop("_chunk").withColumn("oi", F.coalesce("oi", F.lit(0.0)))


def first_source(sources: list[DataFrame]) -> DataFrame:
    """Per symbol keep the rows of the first source that has the symbol (cache, primary, fallback order)."""
    u = None
    for i, s in enumerate(sources):
        t = s.withColumn("source", F.lit(i))
        u = t if u is None else u.unionByName(t)
    return (
        u.withColumn("_best", F.min("source").over(W.partitionBy("symbol")))
        .filter("source = _best")
        .drop("_best")
    )


def with_provisional(bars: DataFrame, quotes: DataFrame, day: str) -> DataFrame:
    """Add a flat bar (O=H=L=C=quote, volume 0) for each quoted symbol that has no bar on ``day``."""
    d = F.lit(day).cast("date")
    have = bars.filter(F.col("date") == d).select("symbol")
    q = quotes.join(have, "symbol", "left_anti").select(
        "symbol", d.alias("date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(0.0).alias("volume"),
    )
    return bars.unionByName(q, allowMissingColumns=True)


def latest_partition(df: DataFrame, day: str = "date") -> DataFrame:
    """Rows of the newest day only: a scalar subquery over that one column, so the scan is pruned by it."""
    newest = F.max(day)
    if dict(df.dtypes)[day] != "date":
        newest = F.date_trunc("day", newest).cast(dict(df.dtypes)[day])
    return df.where(F.col(day) >= df.agg(newest).scalar())
