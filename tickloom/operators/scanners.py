"""Scanners: per-symbol patterns expressed as columns, then signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import all_present, bands, c, clip, rnd, sdiv, truth
from ..functions.rank import percent_rank_avg
from ..functions.rolling import rolling
from .consensus import signal

# fixed values: RSI averaging ladder
STEPS = [(5.0, "Step 7 (Average < 5)"), (10.0, "Step 6 (Average < 10)"), (15.0, "Step 5 (Average < 15)"), (20.0, "Step 4 (Average < 20)"), (25.0, "Step 3 (Average < 25)"), (30.0, "Step 2 (Average < 30)")]
NEXT_THRESHOLDS = [30.0, 25.0, 20.0, 15.0, 10.0, 5.0]


def step_hint(rsi: Column) -> Column:
    return F.when(rsi.isNull(), "Unknown").otherwise(bands(rsi, STEPS, "Step 1 (Entry < 35)", op="<"))


def rsi_scan(snap: DataFrame, universe: DataFrame | None = None, members: DataFrame | None = None, entry: float = 35.0) -> DataFrame:
    """RSI below ``entry`` inside the universe, most oversold first."""
    s = snap if universe is None else snap.join(universe.select("symbol"), "symbol", "left_semi")
    s = s.filter(c.rsi_14 < entry)
    if members is not None:
        s = s.join(members.select("symbol", F.lit(True).alias("in_index")), "symbol", "left")
    else:
        s = s.withColumn("in_index", F.lit(False))
    return s.withColumns(
        {
            "in_index": F.coalesce("in_index", F.lit(False)),
            "amo_price": rnd(c.prev_close - 0.01, 2),
            "step_hint": step_hint(c.rsi_14),
            "conviction": rnd(clip((entry - c.rsi_14) / 25.0, 0.0, 1.0), 2),
        }
    ).orderBy("rsi_14", "symbol")


def best_pick(scan: DataFrame) -> DataFrame:
    """The most oversold candidate: a single-row minimum, not a sort."""
    return scan.agg(F.min_by(F.struct("symbol", "rsi_14", "amo_price", "step_hint"), F.struct("rsi_14", "symbol")).alias("b")).select("b.*").filter("symbol is not null")


def averaging(holdings: DataFrame, snap: DataFrame, min_drop: float = 3.14, max_step: int = 7) -> DataFrame:
    """Is a holding (last_buy_price, last_step) due for the next RSI step?"""
    j = holdings.join(snap.select("symbol", "close", "rsi_14"), "symbol")
    limit = F.get(F.array(*[F.lit(x) for x in NEXT_THRESHOLDS]), c.last_step - 1)
    drop = F.coalesce(F.when(c.last_buy_price > 0, (c.last_buy_price - c.close) / c.last_buy_price * 100.0), F.lit(0.0))
    ok = truth((c.last_step < max_step) & (c.rsi_14 < limit) & (drop >= min_drop))
    return j.withColumns({"price_drop_pct": drop, "eligible": ok, "next_step": F.when(ok, c.last_step + 1)})


def darvas(bars: DataFrame, window: int = 20, min_days: int = 5, spike: float = 1.5) -> DataFrame:
    """Box of the last ``window`` bars for every bar: streak of bars without a new high, breakout labels, conviction."""
    half = max(window // 2, 5)
    b = rolling(ts.position(bars), {"_hi": ("max", "high", window), "box_low": ("min", "low", half), "_va": ("mean", "volume", 20)})
    b = b.withColumn("box_high", ts.lag(F.col("_hi")))
    b = ts.with_streak(b, c.high <= c.box_high, "_today")
    b = b.withColumn("_yday", F.coalesce(ts.lag(F.col("_today")), F.lit(0)))
    vol = truth((F.col("_va") > 0) & (c.volume >= spike * F.col("_va")))
    armed, above, below = F.col("_yday") >= min_days, truth(c.close > c.box_high), truth(c.close < c.box_low)
    ready = c.bn + 1 >= window + min_days
    b = b.withColumn(
        "darvas_signal",
        F.when(~ready, "Insufficient Data")
        .when(armed & above & vol, "Breakout (Volume Confirmed)")
        .when(armed & below & vol, "Breakdown (Volume Confirmed)")
        .when(armed & above, "Breakout (No Volume Confirmation)")
        .when(F.col("_today") >= min_days, F.format_string("Consolidating (%d days)", F.col("_today")))
        .otherwise("No Pattern"),
    )
    broke = c.darvas_signal.startswith("Break")
    return b.withColumns(
        {"vol_confirmed": vol & ready, "box_days": F.when(~ready, 0).when(broke, F.col("_yday")).otherwise(F.col("_today")).cast("int"), "conviction": F.when(vol, 1.0).otherwise(0.5)}
    ).drop("_hi", "_va", "_today", "_yday", "bn", "n_bars")


def momentum_squeeze(bars: DataFrame, n: int = 20, mult: float = 1.5) -> DataFrame:
    """Squeeze state, regression momentum and colours per bar that has a momentum (band width uses the channel multiplier)."""
    return squeeze_columns(bars, n, mult).filter(c.momentum.isNotNull())


def squeeze_columns(bars: DataFrame, n: int = 20, mult: float = 1.5) -> DataFrame:
    """:func:`momentum_squeeze` for every bar; the columns are NULL or false where there is no momentum."""
    prev = ts.lag(c.close)
    b = bars.withColumn("_tr", F.greatest(c.high - c.low, F.abs(c.high - prev), F.abs(c.low - prev)))
    b = b.withColumns({"_m": ts.mean(c.close, n), "_d": ts.std(c.close, n), "_a": ts.mean(F.col("_tr"), n), "_h": ts.highest(c.high, n), "_l": ts.lowest(c.low, n)})
    b = b.withColumn("_src", c.close - ((F.col("_h") + F.col("_l")) / 2 + F.col("_m")) / 2)
    b = ts.linreg_end(b, "_src", n, "momentum")
    m, d, a, v = F.col("_m"), F.col("_d"), F.col("_a"), c.momentum
    b = b.withColumn("_pv", F.coalesce(ts.lag(v), F.lit(0.0)))
    on = truth((m - mult * d > m - mult * a) & (m + mult * d < m + mult * a))
    off = truth((m - mult * d < m - mult * a) & (m + mult * d > m + mult * a))
    b = b.withColumns(
        {
            "squeeze_on": on, "squeeze_off": off, "no_squeeze": ~on & ~off,
            "hist_color": F.when(v > 0, F.when(v > F.col("_pv"), "lime").otherwise("green")).when(v < F.col("_pv"), "red").otherwise("maroon"),
        }
    )
    return b.drop("_tr", "_m", "_d", "_a", "_h", "_l", "_src", "_pv")


def squeeze_signals(sq: DataFrame, last: int = 10) -> DataFrame:
    t = ts.tail(sq, last)
    strong = c.hist_color.isin("lime", "red")
    return signal(t, "momentum_squeeze", F.when(c.hist_color.isin("lime", "green"), 1).otherwise(-1), F.when(strong, 1.0).otherwise(0.5), c.date, {"color": c.hist_color, "squeeze_on": c.squeeze_on})


def leaders(bars: DataFrame, exclude_today: bool = False, pocket_min: int = 10) -> DataFrame:
    """Relative-strength screen columns of the latest bar (before the cross-sectional rank); see :func:`leader_columns`."""
    keep = ["symbol", "date", "close", *LEADER_COLUMNS, "n_bars"]
    return ts.latest(leader_columns(ts.position(bars), exclude_today, pocket_min).select(*keep))


LEADER_COLUMNS = ("rs", "template_score", "rvol", "high_proximity", "stage2", "pivot", "breakout", "pocket_pivot", "contraction")


def leader_columns(bars: DataFrame, exclude_today: bool = False, pocket_min: int = 10) -> DataFrame:
    """Relative-strength screen columns of every bar.

    ``exclude_today`` compares the breakout with the high before today; ``pocket_min``
    is how many down days the 10-bar window needs for a pocket pivot.
    """
    b = rolling(
        bars,
        {
            **{f"_m{n}": ("mean", "close", n) for n in (50, 150, 200)}, "_hi": ("max", "high", 252), "_lo": ("min", "low", 252),
            "_vm": ("mean", "volume", 50), "_base": ("max", "high", 60),
        },
    )
    down = F.when(ts.diff(c.close) < 0, c.volume)
    b = b.withColumns({"_dv": down, "_ar": F.abs(ts.pct_change(c.close)), **{f"_r{n}": ts.pct_change(c.close, n) for n in (252, 126, 63, 21)}})
    w10 = ts.back(10)
    b = b.withColumns({"_mdv": F.when(F.count("_dv").over(w10) >= pocket_min, F.max("_dv").over(w10)), "_v20": ts.mean(F.col("_ar"), 20)})
    x = F.col
    b = b.withColumns({"_p200": ts.lag(x("_m200"), 30), "_p50": ts.lag(x("_m50"), 9), "_pv20": ts.lag(x("_v20"), 39), "_pbase": ts.lag(x("_base"))})
    one = lambda cond: truth(cond).cast("int")
    px = c.close
    score = (
        one(px > x("_m50")) + one(px > x("_m150")) + one(px > x("_m200")) + one(x("_m50") > x("_m150")) + one(x("_m50") > x("_m200")) + one(x("_m150") > x("_m200"))
        + one(px >= x("_lo") * 1.30) + one(px >= x("_hi") * 0.75) + one(x("_m200") > x("_p200"))
    )
    b = b.withColumns(
        {
            "rs": 0.4 * x("_r252") + 0.2 * x("_r126") + 0.2 * x("_r63") + 0.2 * x("_r21"),
            "template_score": score, "rvol": sdiv(c.volume, x("_vm")), "high_proximity": sdiv(px, x("_hi")),
            "stage2": truth((px > x("_m150")) & (x("_m150") > x("_m200")) & (x("_m50") > x("_p50"))),
            "pivot": x("_base"), "breakout": truth(px > (x("_pbase") if exclude_today else x("_base"))), "pocket_pivot": truth(c.volume > x("_mdv")),
            "contraction": truth(x("_v20") < x("_pv20")),
        }
    )
    return b.select(*bars.columns, *LEADER_COLUMNS)


def leader_table(bars: DataFrame, min_bars: int = 256, **kw) -> DataFrame:
    """Screen columns plus the percentile RS rating over all symbols with enough history."""
    t = leaders(bars, **kw).filter(c.n_bars >= min_bars).withColumn("rs", rnd("rs", 8))
    return percent_rank_avg(t, "rs", "rs_rating")


def leader_candidates(t: DataFrame, min_rs: float = 70.0, min_template: int = 8, min_proximity: float = 0.85, min_rvol: float = 1.2) -> DataFrame:
    ok = (c.rs_rating >= min_rs) & (c.template_score >= min_template) & c.stage2 & (c.high_proximity >= min_proximity) & (c.rvol >= min_rvol)
    return t.filter(ok).withColumn("conviction", rnd(clip((c.rs_rating - 70.0) / 30.0, 0.0, 1.0), 2)).orderBy(F.desc("rs_rating"), "symbol")


def rotation(bars: DataFrame, bench: DataFrame, mean: int = 40, step: int = 10) -> DataFrame:
    """Relative-strength ratio, momentum and quadrant of the latest bar against a benchmark (one row per day, broadcast)."""
    b = bars.join(F.broadcast(bench), "date").withColumn("_rs", sdiv(c.close, c.bench))
    b = rolling(b, {"_m": ("mean", "_rs", mean)}).withColumn("rs_ratio", sdiv(F.col("_rs"), F.col("_m")) * 100)
    b = b.withColumn("rs_momentum", (sdiv(c.rs_ratio, ts.lag(c.rs_ratio, step)) - 1) * 100)
    r, m = c.rs_ratio, c.rs_momentum
    quad = F.when((r > 100) & (m > 0), "Leading").when((r > 100) & (m < 0), "Weakening").when((r < 100) & (m < 0), "Lagging").otherwise("Improving")
    order = F.when(c.quadrant == "Leading", 1).when(c.quadrant == "Improving", 2).when(c.quadrant == "Weakening", 3).otherwise(4)
    t = ts.latest(b).filter(all_present(r, m)).withColumn("quadrant", quad)
    return t.select("symbol", "rs_ratio", "rs_momentum", "quadrant").orderBy(order, F.desc("rs_ratio"))


def scanner_metrics(signals: DataFrame) -> DataFrame:
    """Signals and buy/sell counts of each scanner."""
    return signals.groupBy("strategy_name").agg(F.count(F.lit(1)).alias("signals"), F.count_if(c.action == 1).alias("buys"), F.count_if(c.action == -1).alias("sells"), F.avg("conviction").alias("avg_conviction"))
