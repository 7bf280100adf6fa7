"""Data quality, incremental maintenance and registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, rnd, sdiv, truth
from ..sources.bars import keep_last


def coverage(bars: DataFrame) -> DataFrame:
    """Rows against the expected trading days of the symbol's span, and a health status."""
    g = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max(c.volume == 0).alias("_zv"), F.max(c.close == 0).alias("_zc"),
    )
    expected = F.floor(F.datediff("last_date", "first_date") / 365.25 * 252)
    g = g.withColumn("coverage_pct", F.when(expected > 20, F.least(F.lit(100.0), rnd(c.rows / expected * 100.0, 1))).otherwise(100.0))
    status = F.when(c.rows < 2, "INSUFFICIENT_HISTORY").when(c.coverage_pct < 85.0, "LOW_COVERAGE").when(F.col("_zv"), "ZERO_VOLUME").when(F.col("_zc"), "ZERO_CLOSE").otherwise("HEALTHY")
    return g.withColumn("dq_status", status).drop("_zv", "_zc")


def status_table(requested: DataFrame, cov: DataFrame, healthy: float = 95.0) -> DataFrame:
    """One row per requested symbol; rows 0 when there is no history."""
    j = requested.join(cov, "symbol", "left")
    return j.withColumns({"rows": F.coalesce("rows", F.lit(0)), "healthy": truth(c.coverage_pct >= healthy)})


PRICES, CELLS = ("open", "high", "low", "close"), ("open", "high", "low", "close", "volume")


def integrity(rows: DataFrame) -> DataFrame:
    """Integrity counts per symbol of raw rows, each fault counted by itself.

    Repeated dates, missing (null or NaN) and infinite cells by column, prices that are not positive, broken bounds, moves
    above 50 % and gaps of more than 7 days between rows in the order of date, close and volume.
    """
    w = W.partitionBy("symbol").orderBy("date", "close", "volume")
    num = {x: F.col(x).cast("double") for x in CELLS}
    missing = lambda x: F.col(x).isNull() | F.isnan(num[x])
    b = rows.withColumns({"_gap": F.datediff("date", F.lag("date").over(w)), "_ret": sdiv(c.close, F.lag("close").over(w)) - 1})
    n = lambda cond: F.count_if(truth(cond))
    real = {x: F.nanvl(num[x], F.lit(None).cast("double")) for x in PRICES}  # NaN is above nothing
    bounds = [real[a] < real[b] for a, b in (("high", "low"), ("high", "open"), ("high", "close"), ("open", "low"), ("close", "low"))]
    return b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count_distinct("date")).alias("duplicate_rows"),
        *[n(missing(x)).alias(f"null_{x}") for x in CELLS],
        *[n(F.abs(num[x]) == float("inf")).alias(f"inf_{x}") for x in CELLS],
        sum((n(F.col(x) <= 0) for x in PRICES[1:]), n(F.col(PRICES[0]) <= 0)).alias("non_positive"),
        sum((n(x) for x in bounds[1:]), n(bounds[0])).alias("bound_violations"),
        n((F.abs(F.col("_ret")) > 0.5) & ~F.isnan("_ret")).alias("extreme_returns"),
        n(F.col("_gap") > 7).alias("long_gaps"),
    )


def drop_bad_rows(bars: DataFrame) -> DataFrame:
    """Positive volume, then an opening gap below 25 % of the previous kept close, then a positive close."""
    b = bars.filter(c.volume > 0).withColumn("_pc", ts.lag(c.close))
    gap = F.abs(sdiv(c.open, F.col("_pc")) - 1)
    return b.filter(F.col("_pc").isNull() | truth(gap < 0.25)).filter(c.close > 0).drop("_pc")


OUTLIER_FEATURES = ["gap", "ret", "hl_spread", "vol_z"]


def outlier_features(bars: DataFrame, n: int = 20) -> DataFrame:
    """Opening gap, return, high-low spread and volume z-score; undefined values are 0."""
    prev = ts.lag(c.close)
    b = bars.withColumns({"_g": sdiv(c.open, prev) - 1, "_r": sdiv(c.close, prev) - 1, "_m": ts.mean(c.volume, n), "_s": ts.std(c.volume, n)})
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return b.withColumns(
        {"gap": zero(F.col("_g")), "ret": zero(F.col("_r")), "hl_spread": zero(sdiv(c.high - c.low, c.close)), "vol_z": zero((c.volume - F.col("_m")) / (F.col("_s") + 1e-9))}
    ).drop("_g", "_r", "_m", "_s")


# fixed values: price factors of splits and bonuses, first match wins
ADJUST_FACTORS = [0.5, 0.2, 0.1, 1 / 1.5, 0.8, 1 / 3, 0.25]


def _near_standard(ratio: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in ADJUST_FACTORS]), lambda x: F.abs(ratio - x) < 0.05)


def _rule(ratio: Column) -> Column:
    """The decision without a model: a fall below 0.8 or a rise above 2 is checked against the standard ratios."""
    return F.when(truth((ratio < 0.8) | (ratio > 2.0)) & truth(_near_standard(ratio)), "CORP_ACTION").when(truth(ratio < 0.8), "BAD_TICK").otherwise("OK")


def bar_gate(bars: DataFrame, flagged: Column | None = None, lookback: int = 252, least: int = 50) -> DataFrame:
    """OK / BAD_TICK / CORP_ACTION for each bar against the bars before it.

    A bar is looked at if the model flags it (``flagged``) or it moves by more than 20 %.  Near a standard ratio it is a
    corporate action; else it is bad if extreme or more than five deviations off the mean return of the last ``lookback``
    bars, whose first return counts as 0.  With less than ``least`` bars before it the plain rule decides.
    """
    b = bars.withColumns({"_pc": ts.lag(c.close), "_r": ts.pct_change(c.close), "_flag": F.lit(False) if flagged is None else truth(flagged)})
    rows, moves = (ts.by_symbol().rowsBetween(-k, -1) for k in (lookback, lookback - 1))
    b = b.withColumns({"_all": F.count(F.lit(1)).over(ts.by_symbol().rowsBetween(W.unboundedPreceding, -1)), "_n": F.count(F.lit(1)).over(rows), "_s": F.sum("_r").over(moves), "_ss": F.sum(F.col("_r") * F.col("_r")).over(moves)})
    mean = sdiv(F.col("_s"), F.col("_n"))
    dev = F.sqrt(sdiv(F.col("_ss") - F.col("_s") * mean, F.col("_n") - 1))
    ratio = F.when((c.close > 0) & (F.col("_pc") > 0), sdiv(c.close, F.col("_pc")))
    extreme = truth((ratio < 0.8) | (ratio > 1.2))
    look = ratio.isNotNull() & (F.col("_flag") | extreme)
    z = F.abs(sdiv(ratio - 1 - mean, dev))
    model = F.when(look & truth(_near_standard(ratio)), "CORP_ACTION").when(look & truth(dev > 0) & (extreme | truth(z > 5.0)), "BAD_TICK").otherwise("OK")
    verdict = F.when(F.col("_all") < least, _rule(ratio)).otherwise(model)
    return b.withColumn("verdict", verdict).drop("_pc", "_r", "_flag", "_all", "_n", "_s", "_ss")


def gate_fallback(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, ratio, decision) of the first new close against the last old one, by the plain rule."""
    return append_ratio(old, new).select("symbol", "ratio", _rule(c.ratio).alias("decision"))


def append_ratio(old: DataFrame, new: DataFrame, low: float = 0.8, high: float = 2.0) -> DataFrame:
    """First new close over last old close per symbol; outside the band the symbol needs a full refresh."""
    a = old.groupBy("symbol").agg(F.max_by("close", "date").alias("last_old"))
    b = new.groupBy("symbol").agg(F.min_by("close", "date").alias("first_new"))
    r = sdiv(c.first_new, c.last_old)
    return b.join(a, "symbol", "left").withColumn("ratio", r).withColumn("refresh", truth((c.ratio < low) | (c.ratio > high)))


def append_or_reject(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old bars plus the new ones of accepted symbols; a repeated date keeps the new row."""
    good = append_ratio(old, new).filter(~c.refresh).select("symbol")
    u = old.withColumn("_v", F.lit(0)).unionByName(new.join(good, "symbol", "left_semi").withColumn("_v", F.lit(1)))
    return keep_last(u, ["symbol", "date"], F.col("_v")).drop("_v")


def missing_days(last_bars: DataFrame, last_day: Column, days_back: int = 30) -> DataFrame:
    """Distinct weekdays after any symbol's last bar up to the last trading day, at most ``days_back`` back."""
    start = F.greatest(F.date_add("date", 1), F.date_sub(last_day, days_back))
    # symbols with the same last bar miss the same days: reduce to distinct starts first
    s = last_bars.select(start.alias("_s")).distinct().filter(F.col("_s") <= last_day)
    days = s.select(F.explode(F.sequence("_s", last_day)).alias("day")).distinct()
    return days.filter(~F.dayofweek("day").isin(1, 7))


def adjust_factors(old: DataFrame, new: DataFrame, band: float = 0.05) -> DataFrame:
    """Per symbol: factor for the old prices (1 = none), or ``refresh`` when the jump matches no standard factor."""
    o = old.select("symbol", "date", F.col("close").alias("_oc"))
    j = new.select("symbol", "date", "close").join(o, ["symbol", "date"], "left")
    g = j.groupBy("symbol").agg(
        F.min_by(F.when(F.col("_oc").isNotNull(), sdiv(c.close, F.col("_oc"))), F.when(F.col("_oc").isNotNull(), c.date)).alias("overlap"), F.min_by("close", "date").alias("_fn")
    ).join(old.groupBy("symbol").agg(F.max_by("close", "date").alias("_lo")), "symbol")
    ratio = F.coalesce(c.overlap, sdiv(F.col("_fn"), F.col("_lo")))
    jump = F.when(c.overlap.isNotNull(), (c.overlap < 0.95) | (c.overlap > 1.05)).otherwise(ratio < 0.79)
    match = F.get(F.filter(F.array(*[F.lit(x) for x in ADJUST_FACTORS]), lambda f: F.abs(ratio - f) <= band), F.lit(0))
    return g.select("symbol", ratio.alias("ratio"), F.when(truth(jump), match).otherwise(1.0).alias("factor"), (truth(jump) & match.isNull()).alias("refresh"))


def back_adjust(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old bars with prices times the factor and volume divided by it."""
    f = adjust_factors(old, new).filter(~c.refresh).select("symbol", "factor")
    j = old.join(f, "symbol")
    return j.withColumns({**{x: F.col(x) * c.factor for x in ("open", "high", "low", "close")}, "volume": c.volume / c.factor}).drop("factor")


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows before, after and added by an append with dedupe, per symbol."""
    keys = old.select("symbol", "date", F.lit(1).alias("_o")).unionByName(new.select("symbol", "date", F.lit(0).alias("_o")))
    g = keys.groupBy("symbol", "date").agg(F.max("_o").alias("_o")).groupBy("symbol")
    return g.agg(F.sum("_o").cast("long").alias("before"), F.count(F.lit(1)).alias("after")).withColumn("added", c.after - c.before)


def needs_refresh(cov: DataFrame, as_of: Column) -> DataFrame:
    """Fewer than 2 rows; coverage under 0.8 when more than 50 rows are expected; or stale and short."""
    expected = F.floor(F.datediff("last_date", "first_date") / 365.25 * 252)
    stale = (F.datediff(as_of, "last_date") > 7) & (c.rows < 100)
    return cov.withColumn("full_refresh", truth((c.rows < 2) | ((expected > 50) & (c.rows / expected < 0.8)) | stale))


def registry(bars: DataFrame, as_of: Column) -> DataFrame:
    """Sync registry rows: status, first and last bar, row count."""
    g = bars.groupBy("symbol").agg(F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.count(F.lit(1)).alias("rows"))
    status = F.when(c.rows < 2, "pending").when(F.datediff(as_of, c.last_bar) > 60, "failed").otherwise("ok")
    return g.withColumn("status", status)


def update_order(reg: DataFrame, as_of: Column) -> DataFrame:
    """Rows that need an update, in priority order: pending, failed, ok; older last bar; more rows."""
    pr = F.when(c.status == "pending", 0).when(c.status == "failed", 1).otherwise(2)
    r = reg.withColumns({"priority": pr, "update_needed": (c.status != "ok") | truth(c.last_bar < as_of)})
    return r.filter("update_needed").orderBy("priority", "last_bar", F.desc("rows"), "symbol")


def registry_summary(reg: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(c.status == s).alias(s)
    return reg.agg(F.count(F.lit(1)).alias("total"), n("ok"), n("failed"), n("pending"), F.sum("rows").alias("rows")).withColumn("coverage_pct", rnd(sdiv(c.ok * 100.0, c.total), 1))


def heal(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Replace volume and turnover on the days the daily file covers."""
    f = daily.select("symbol", "date", F.col("volume").alias("_v"), F.col("turnover").alias("_t"))
    j = bars.join(f, ["symbol", "date"], "left")
    return j.withColumns({"volume": F.coalesce("_v", "volume"), "turnover": F.coalesce("_t", "turnover")}).drop("_v", "_t")


def last_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Latest calendar day on or before each day and whether the day itself trades.

    Both sides are sets of calendar days (thousands of rows), merged in date order.
    """
    marks = days.select("day", F.lit(1).alias("_q")).unionByName(calendar.select("day", F.lit(0).alias("_q")))
    g = marks.groupBy("day").agg(F.max("_q").alias("_q"), F.max(F.col("_q") == 0).alias("is_trading"))
    last = F.last(F.when(c.is_trading, c.day), ignorenulls=True).over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return g.withColumn("last_trading_day", last).filter("_q = 1").drop("_q")


def parity(panel: DataFrame) -> DataFrame:
    """Mean and largest absolute difference of RSI, SMA-50 and ATR from a second formulation, at each symbol's last bar.

    The second form folds the ordered bars of the symbol (bounded by the calendar).
    """
    g = panel.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("date", "high", "low", "close"))).alias("a"),
        *[F.max_by(x, "date").alias(x) for x in ("rsi_14", "sma_50", "atr_14")],
    )
    z = F.lit(0.0)
    start = F.struct(F.lit(-1).alias("i"), z.alias("p"), z.alias("g"), z.alias("d"), z.alias("t"))

    def step(s: Column, x: Column) -> Column:
        i = s["i"] + 1
        ch = x["close"] - s["p"]
        tr = F.greatest(x["high"] - x["low"], F.abs(x["high"] - s["p"]), F.abs(x["low"] - s["p"]))
        upd = lambda old, v: F.when(i == 0, z).when(i <= 14, old + v / 14.0).otherwise((old * 13.0 + v) / 14.0)
        return F.struct(i.alias("i"), x["close"].alias("p"), upd(s["g"], F.greatest(ch, z)).alias("g"), upd(s["d"], F.greatest(-ch, z)).alias("d"), upd(s["t"], tr).alias("t"))

    g = g.withColumn("f", F.aggregate("a", start, step))
    sma = F.aggregate(F.slice("a", -50, 50), z, lambda s, x: s + x["close"]) / 50.0
    g = g.filter(F.size("a") >= 50).select(
        F.abs(c.rsi_14 - 100.0 * c.f.g / (c.f.g + c.f.d)).alias("rsi"), F.abs(c.sma_50 - sma).alias("sma"), F.abs(c.atr_14 - c.f.t).alias("atr")
    )
    return g.agg(*[f(x).alias(f"{n}_{x}") for x in ("rsi", "sma", "atr") for n, f in (("mean", F.avg), ("max", F.max))])
