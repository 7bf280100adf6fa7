"""Trend, accumulation and swing classifiers.  Bar-wise columns unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import all_present, bands, c, money, sdiv, stacked, truth
from ..functions.rolling import rolling
from ..sources.bars import resample


def diff_200(panel: DataFrame) -> DataFrame:
    """Distance of the close from the 200-bar mean in percent."""
    return panel.withColumn("diff_200", F.when(c.sma_200 > 0, (c.close - c.sma_200) * 100.0 / c.sma_200))


def _status(mas: list[str], cap: float, tag: str) -> Column:
    cols = [F.col(m) for m in mas]
    up = stacked(c.close, *cols) & c.diff_200.between(0.01, cap)
    down = stacked(*reversed(cols), c.close) & c.diff_200.between(-cap, -0.01)
    return (
        F.when(~all_present(*cols), "Insufficient History")
        .when(up, "In Bull Run" + tag)
        .when(down, "In Bear Run" + tag)
        .otherwise("Unconfirmed")
    )


def trend_status(panel: DataFrame, cap: float = 20.0) -> DataFrame:
    """Bull: close > sma20 > sma50 > sma100 > sma200 and at most ``cap`` % above the 200-bar mean; bear mirrored."""
    return diff_200(panel).withColumn("trend_status", _status(["sma_20", "sma_50", "sma_100", "sma_200"], cap, ""))


def trend_status_sl(panel: DataFrame, cap: float = 20.0) -> DataFrame:
    """As :func:`trend_status` with sma150 in the stack."""
    return diff_200(panel).withColumn("trend_status_sl", _status(["sma_20", "sma_50", "sma_100", "sma_150", "sma_200"], cap, " (SL)"))


def trend_status_simple(panel: DataFrame, cap: float = 10.0) -> DataFrame:
    """Older rule: close above (below) each of the 50/100/200 means and within ``cap`` %."""
    above = (c.close > c.sma_50) & (c.close > c.sma_100) & (c.close > c.sma_200)
    below = (c.close < c.sma_50) & (c.close < c.sma_100) & (c.close < c.sma_200)
    return diff_200(panel).withColumn(
        "trend_status_simple",
        F.when(c.sma_200.isNull(), "Insufficient History")
        .when(above & c.diff_200.between(0.01, cap), "In Bull Run")
        .when(below & c.diff_200.between(-cap, -0.01), "In Bear Run")
        .otherwise("Unconfirmed"),
    )


def car_columns(bars: DataFrame) -> DataFrame:
    """Running mean of the close since the first bar with the highest high (NULL before it)."""
    b = ts.position(bars.filter(all_present(c.high, c.close)))
    b = b.withColumn("_top", F.max("high").over(ts.whole()))
    b = b.withColumn("_at", F.min(F.when(c.high == F.col("_top"), c.bn)).over(ts.whole()))
    since = c.bn >= F.col("_at")
    b = b.withColumn("car_avg", F.when(since, F.avg(F.when(since, c.close)).over(ts.sofar())))
    return b.withColumn("car_prev", ts.lag(c.car_avg)).drop("_top", "_at")


def car_aggs() -> dict[str, Column]:
    return {
        "_cn": F.count(F.lit(1)),
        "_cs": F.count("car_avg"),
        "_above": F.count_if((ts.age() < 10) & (c.close > c.car_avg)),
        "_rising": F.count_if((ts.age() < 9) & (c.car_avg > c.car_prev)),
    }


def car_labels(per_symbol: DataFrame, need: int = 8) -> DataFrame:
    """Buy when at least ``need`` of the last ten closes lie above the running mean."""
    short = (F.col("_cn") < 10) | (F.col("_cs") < 10)
    label = lambda ok: F.when(short, "Short History").when(ok, "Buy/Average Out").otherwise("Avoid/Hold")
    return per_symbol.withColumns({"car_rating": label(F.col("_above") >= need), "car_rising": label(F.col("_rising") == 9)}).drop(*car_aggs())


def car_rating(bars: DataFrame, need: int = 8) -> DataFrame:
    """Cumulative-average rating per symbol: ``car_rating`` and the stricter rising-mean ``car_rising``."""
    return car_labels(car_columns(bars).groupBy("symbol").agg(*[v.alias(k) for k, v in car_aggs().items()]), need)


def bottom_out(bars: DataFrame, tolerance: float = 0.5, buffer: float = 1.0, n: int = 20) -> DataFrame:
    """Test of the n-bar low and the bounce from it, for every bar."""
    return bottom_out_columns(rolling(bars, {"high_20d": ("max", "high", n), "low_20d": ("min", "low", n)}), tolerance, buffer)


def bottom_out_columns(b: DataFrame, tolerance: float = 0.5, buffer: float = 1.0) -> DataFrame:
    """:func:`bottom_out` where ``high_20d`` and ``low_20d`` are already there."""
    b = b.withColumn("gtt_trigger", c.high_20d)
    off_floor = sdiv(F.abs(c.low - c.low_20d), c.low_20d) * 100.0
    b = b.withColumn("bounce_pct", sdiv(c.close - c.low_20d, c.low_20d) * 100.0)
    tested, bounced = truth(off_floor <= tolerance), c.close > c.low
    case = lambda short, bad, far, flat, weak, good: (
        F.when(c.low_20d.isNull(), short).when(c.low_20d <= 0, bad).when(~tested, far)
        .when(~bounced, flat).when(c.bounce_pct < buffer, weak).otherwise(good)
    )
    fmt = F.format_string
    return b.withColumns(
        {
            "bottom_out_status": case("Short History", "Invalid Low", "Do not start GTT", "Do not start GTT", "Start GTT (Basic)", "Start GTT"),
            "swing_advice": case(
                F.lit("Wait"), F.lit("Wait"), F.lit("Wait for best time"), F.lit("No bounce — avoid"),
                fmt("Place GTT at %s | Weak bounce (%s%%)", money(c.high_20d), money(c.bounce_pct)),
                fmt("Place GTT Buy at %s | Stop below %s | Bounce: %s%%", money(c.high_20d), money(c.low), money(c.bounce_pct)),
            ),
            "gtt_target_20pct": c.gtt_trigger * 1.20,
        }
    )


def circuit(bars: DataFrame) -> DataFrame:
    """Upper/lower circuit band hit by a close at the day's extreme."""
    b = bars if "prev_close" in bars.columns else bars.withColumn("prev_close", ts.lag(c.close))
    move = sdiv(c.close - c.prev_close, c.prev_close) * 100.0

    def side(code: str, r: Column, at_edge: Column) -> Column:
        return (
            F.when(at_edge & (r >= 19.8), f"{code} (20%)")
            .when(at_edge & (r >= 9.8) & (r < 15.0), f"{code} (10%)")
            .when(at_edge & (r >= 4.8) & (r < 7.0), f"{code} (5%)")
        )

    up = side("UC", move, (c.close > c.prev_close) & (F.abs(c.close - c.high) < 1e-4))
    down = side("LC", -move, (c.close < c.prev_close) & (F.abs(c.close - c.low) < 1e-4))
    return b.withColumn("circuit_type", F.coalesce(up, down, F.lit("None"))).withColumn("circuit_locked", c.circuit_type != "None")


def ma_slope(bars: DataFrame, window: int = 20, period: int = 30) -> DataFrame:
    """Least-squares slope of the last ``period`` values of the moving average, per symbol."""
    b = ts.tail(bars.withColumn("_ma", ts.mean(c.close, window)).withColumn("_i", ts.bar_no()), period)
    per = b.groupBy("symbol").agg(F.count("_ma").alias("n"), F.regr_slope("_ma", "_i").alias("slope"))
    a = F.abs(c.slope)
    strength = bands(a, [(0.1, "very weak"), (0.5, "weak"), (1.0, "moderate"), (2.0, "strong")], "very strong", op="<")
    text = F.when(a < 0.05, "mostly flat").otherwise(F.concat_ws(" ", strength, F.when(c.slope > 0, "upward").otherwise("downward")))
    return per.filter(c.n == period).select("symbol", "slope", text.alias("trend"))


def market_state(panel: DataFrame) -> DataFrame:
    """BULL RUN / RECOVERY / BEAR TERRITORY / SIDEWAYS from close and the 50/200 means, falling back when one is missing."""
    has50, has200 = truth(c.sma_50 > 0), truth(c.sma_200 > 0)
    two = (
        F.when((c.close > c.sma_200) & (c.close > c.sma_50), "BULL RUN")
        .when((c.close < c.sma_200) & (c.close > c.sma_50), "RECOVERY")
        .when((c.close < c.sma_200) & (c.close < c.sma_50), "BEAR TERRITORY")
        .otherwise("SIDEWAYS")
    )
    one = lambda ma: F.when(c.close > ma, "BULL RUN").otherwise("BEAR TERRITORY")
    return panel.withColumn(
        "market_state",
        F.when(~truth(c.close > 0), "SIDEWAYS").when(has50 & has200, two).when(has200, one(c.sma_200))
        .when(has50, one(c.sma_50)).otherwise("SIDEWAYS"),
    )


def weekly_cross(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Per symbol: is the weekly fast mean above the slow one (needs ``slow`` weekly bars)?"""
    wk = rolling(resample(bars, "week"), {"_f": ("mean", "close", fast), "_s": ("mean", "close", slow)})
    return ts.latest(wk).select("symbol", truth(F.col("_f") > F.col("_s")).alias("weekly_cross"))


def multi_timeframe(snapshot: DataFrame, weekly: DataFrame) -> DataFrame:
    """Daily bull status confirmed by the weekly cross; a symbol without weekly data is not confirmed."""
    s = snapshot.join(weekly, "symbol", "left").withColumn("weekly_cross", F.coalesce("weekly_cross", F.lit(False)))
    return s.withColumn("mtf_confirmed", c.weekly_cross & (c.trend_status == "In Bull Run"))
