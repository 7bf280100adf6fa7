"""Voting strategies.  Each adds ``<name>_action`` (and target / stop columns where it has them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import all_present, bands, c, money, rnd, sdiv, truth

# order of the 13 voting columns
VOTERS = [
    "rsi_ladder", "buy_low", "turtle", "rdx", "sma100", "dma20", "super_bo",
    "dma_rev", "dma_nosl", "vcp", "squeeze", "supertrend", "knn",
]
BAR_WISE = VOTERS[:9]

_TARGET = 1.0628


def _act(cond: Column, yes: str, no: str = "Hold") -> Column:
    return F.when(cond, yes).otherwise(no)


def bar_strategies(panel: DataFrame) -> DataFrame:
    """The nine strategies that read one bar and its indicators."""
    px, atr = c.close, c.atr_14
    stack = all_present(c.sma_50, c.sma_100, c.sma_150, c.sma_200)
    crossed = (c.prev_close <= c.prev_sma_100) & (px > c.sma_100)
    return panel.withColumns(
        {
            "rsi_ladder_action": bands(c.rsi_14, [(25.0, "Level 3 Buy"), (30.0, "Level 2 Buy"), (35.0, "Level 1 Buy")], "No Action", op="<"),
            "rsi_ladder_target": px * _TARGET,
            "buy_low_action": _act((px - c.low_200) / c.low_200 * 100.0 <= 2.0, "Buy on Support / Demand Level"),
            "buy_low_target": px + 2 * atr,
            "buy_low_sl": c.low_200 - 0.5 * atr,
            "turtle_action": _act(px >= c.prev_high_55, "Buy (55D Breakout)", "No need to fresh start"),
            "turtle_target": px + 3 * atr,
            "turtle_sl": c.low_20,
            "rdx_action": F.when((c.adx_14 > 25) & (c.plus_di_14 > c.minus_di_14) & (c.rsi_14 > 60), "Explosive Buy")
            .when((c.adx_14 > 25) & (c.minus_di_14 > c.plus_di_14) & (c.rsi_14 < 40), "Explosive Sell")
            .otherwise("Hold"),
            "rdx_target": px + 2 * atr,
            "rdx_sl": px - 1.5 * atr,
            "sma100_action": _act(crossed & ((px - c.low_126) / c.low_126 * 100.0 >= 20.0), "Breakout Buy"),
            "sma100_target": px + 3 * atr,
            "sma100_sl": c.sma_100,
            "dma20_diff": F.when(c.sma_20 > 0, (px - c.sma_20) / c.sma_20 * 100.0),
            "dma20_action": _act((c.sma_20 > 0) & ((px - c.sma_20) / c.sma_20 * 100.0 < -2.0), "Buy"),
            "super_bo_action": _act(stack & (px > F.greatest(c.sma_50, c.sma_100, c.sma_150)) & (px < c.sma_200), "Super BO Buy"),
            "super_bo_target": c.sma_200,
            "super_bo_sl": px - 2 * atr,
            "dma_rev_action": _act((px > c.sma_200) & (c.sma_200 > c.sma_150), "150 DMA Breakout | CMP > 200 DMA"),
            "dma_rev_target": px + 2 * atr,
            "dma_rev_sl": c.sma_150,
            "dma_nosl_action": _act((px > c.sma_200) & (px > c.sma_50) & (c.sma_50 > c.sma_200), "50 DMA Breakout | CMP > 200 DMA"),
            "dma_nosl_target": px * _TARGET,
        }
    )


def vcp_columns(panel: DataFrame, swing: int = 5) -> DataFrame:
    """Mark swing peaks and how many peaks are still to come (0 = after the last peak)."""
    p = ts.position(panel).withColumn("_peak", truth(c.high == ts.centred_max(c.high, swing)))
    p = p.withColumn("_seg", F.sum(F.col("_peak").cast("int")).over(ts.sofar()))
    return p.withColumn("_peaks", F.max("_seg").over(ts.whole())).withColumn("_ahead", F.col("_peaks") - F.col("_seg"))


def vcp_aggs() -> dict[str, Column]:
    """Only the last four peaks matter, so each leg is a conditional minimum: no arrays, no range join."""
    at = lambda k: F.col("_peak") & (F.col("_ahead") == k)
    return {
        "_vn": F.count(F.lit(1)),
        "_vp": F.max("_peaks"),
        "_vy": F.max(F.when(ts.age() < 252, c.high)),
        **{f"_ph{k}": F.max(F.when(at(k), c.high)) for k in range(4)},
        **{f"_pl{k}": F.max(F.when(at(k), c.low)) for k in range(4)},
        **{f"_ml{k}": F.min(F.when(F.col("_ahead") == k, c.low)) for k in (1, 2, 3)},
    }


def vcp_labels(per_symbol: DataFrame, lookback: int = 250) -> DataFrame:
    """Needs the latest close, sma_50 and sma_200 beside the aggregates.  A leg runs from peak to next peak, both included."""
    leg = lambda k: (F.col(f"_ph{k}") - F.least(F.col(f"_ml{k}"), F.col(f"_pl{k - 1}"))) / F.col(f"_ph{k}") * 100.0
    n, peaks, high = F.col("_vn"), F.col("_vp"), F.col("_vy")
    s = per_symbol.withColumns({f"_leg{k}": leg(k) for k in (3, 2, 1)})
    l3, l2, l1 = (F.col(f"_leg{k}") for k in (3, 2, 1))
    tight = (l3.isNull() | (l2 <= l3 * 1.1)) & (l1 <= l2 * 1.1) & (l1 < 10.0)
    stage2 = (c.close >= c.sma_50) & (c.close >= c.sma_200)
    pct = lambda x: F.when(x.isNotNull(), F.format_string("%.1f%%", rnd(x, 1)))
    text = F.concat_ws(", ", pct(l3), pct(l2), pct(l1))
    ok = (n >= lookback) & stage2 & (c.close >= 0.75 * high) & (peaks >= 3) & tight
    reason = (
        F.when(n < lookback, F.format_string(f"Insufficient data (%d < {lookback})", n))
        .when(c.sma_50.isNull() | c.sma_200.isNull(), "SMA data unavailable")
        .when(~stage2, "Price below SMA-50 or SMA-200 (Not in Stage 2 uptrend)")
        .when(c.close < 0.75 * high, F.format_string("Price too far from 52W High (%s < 75%% of %s)", money(c.close), money(high)))
        .when(peaks < 3, "Not enough price peaks found to detect contraction")
        .when(tight, F.concat(F.lit("VCP Tightening Detected: Legs("), text, F.lit(")")))
        .otherwise(F.concat(F.lit("No VCP (Legs: "), text, F.lit(")")))
    )
    return s.withColumns({"vcp_action": _act(truth(ok), "VCP Tightening", "No VCP"), "vcp_reason": reason}).drop(
        *vcp_aggs(), "_leg1", "_leg2", "_leg3"
    )


def _agg(df: DataFrame, aggs: dict[str, Column], latest: tuple[str, ...] = ()) -> DataFrame:
    last = [F.max_by(x, "date").alias(x) for x in latest]
    return df.groupBy("symbol").agg(*last, *[v.alias(k) for k, v in aggs.items()])


def vcp(panel: DataFrame, lookback: int = 250, swing: int = 5) -> DataFrame:
    """Volatility contraction per symbol: the legs between the last four swing peaks must tighten."""
    return vcp_labels(_agg(vcp_columns(panel, swing), vcp_aggs(), ("close", "sma_50", "sma_200")), lookback)


def squeeze(panel: DataFrame, n: int = 20, bb: float = 2.0, kc: float = 1.5) -> DataFrame:
    """Bollinger bands inside Keltner channels (for every bar); ATR-14 is used when the column exists."""
    p = ts.position(panel).withColumns({"_m": ts.mean(c.close, n), "_s": ts.std(c.close, n)})
    if "atr_14" in panel.columns:
        return squeeze_columns(p, F.col("_m"), F.col("_s"), c.atr_14, n, bb, kc).drop("_m", "_s")
    p = p.withColumn("_a", ts.mean(_true_range(ts.lag(c.close)), n))
    return squeeze_columns(p, F.col("_m"), F.col("_s"), F.col("_a"), n, bb, kc).drop("_m", "_s", "_a")


def squeeze_columns(p: DataFrame, m: Column, s: Column, a: Column, n: int = 20, bb: float = 2.0, kc: float = 1.5) -> DataFrame:
    ready = truth((c.bn >= n + 13) & all_present(m, s, a))
    on = truth((m + bb * s < m + kc * a) & (m - bb * s > m - kc * a))
    return p.withColumns(
        {
            "squeeze_on": ready & on,
            "squeeze_momentum": F.when(ready, c.close - m),
            "squeeze_action": F.when(~ready, "Insufficient Data")
            .when(on & (c.close - m > 0), "Squeeze Active (Bullish)")
            .when(on, "Squeeze Active (Bearish)")
            .otherwise("No Squeeze"),
        }
    )


def _true_range(prev: Column) -> Column:
    return F.greatest(c.high - c.low, F.abs(c.high - prev), F.abs(c.low - prev))


def supertrend_columns(bars: DataFrame, n: int = 10) -> DataFrame:
    b = ts.position(bars).withColumn("_tr", _true_range(ts.lag(c.close)))
    return b.withColumn("_st_atr", F.coalesce(ts.mean(F.col("_tr"), n), F.lit(0.0))).drop("_tr")


def supertrend_aggs(factor: float = 3.0, name: str = "_st") -> dict[str, Column]:
    """The ordered bars of one symbol (at most one per calendar day) for the fold."""
    mid, width = (c.high + c.low) / 2.0, factor * F.col("_st_atr")
    return {name: F.array_sort(F.collect_list(F.struct("bn", "close", (mid + width).alias("up"), (mid - width).alias("dn"))))}


def supertrend_fold(bars: Column, n: int = 10) -> Column:
    """Direction of the last bar and of the one before (-1 up, 1 down).

    The band carry depends on the direction so far, so this is a true fold, with a
    constant-size accumulator in the JVM.
    """
    start = F.struct(F.lit(1).alias("d"), F.lit(1).alias("p"), F.lit(0.0).alias("up"), F.lit(0.0).alias("dn"))

    def step(acc: Column, x: Column) -> Column:
        flip = F.when(x["bn"] < n, 1).when(x["close"] > acc["up"], -1).when(x["close"] < acc["dn"], 1)
        d = F.coalesce(flip, acc["d"])
        up = F.when(flip.isNull() & (d == 1), F.least(x["up"], acc["up"])).otherwise(x["up"])
        dn = F.when(flip.isNull() & (d == -1), F.greatest(x["dn"], acc["dn"])).otherwise(x["dn"])
        return F.struct(d.alias("d"), acc["d"].alias("p"), up.alias("up"), dn.alias("dn"))

    r = F.aggregate(bars, start, step)
    return F.when(F.size(bars) >= n + 2, F.struct(r["d"].alias("d"), r["p"].alias("p")))


def supertrend_labels(per_symbol: DataFrame, buy: str, sell: str) -> DataFrame:
    b, s = F.col(buy), F.col(sell)
    return per_symbol.withColumns(
        {
            "buy_dir": b["d"],
            "sell_dir": s["d"],
            "supertrend_action": F.when(b["d"].isNull() | s["d"].isNull(), "Insufficient Data")
            .when((b["d"] == -1) & (b["p"] == 1), "Long Entry")
            .when((s["d"] == 1) & (s["p"] == -1), "Close Long")
            .otherwise("Hold"),
        }
    )


def dual_supertrend(bars: DataFrame, buy: tuple[int, float] = (10, 3.0), sell: tuple[int, float] = (10, 3.0)) -> DataFrame:
    """Long Entry when the buy line turns up on the last bar, Close Long when the sell line turns down."""

    def line(n: int, factor: float, name: str) -> DataFrame:
        g = _agg(supertrend_columns(bars, n), supertrend_aggs(factor))
        return g.select("symbol", supertrend_fold(F.col("_st"), n).alias(name))

    t = line(*buy, "_b")
    t = t.withColumn("_s", F.col("_b")) if buy == sell else t.join(line(*sell, "_s"), "symbol")
    return supertrend_labels(t, "_b", "_s").drop("_b", "_s")


def candles(bars: DataFrame) -> DataFrame:
    """Doji, engulfing, hammer, shooting star and morning star per bar (public candle definitions)."""
    body, rng = F.abs(c.close - c.open), c.high - c.low
    b = ts.position(bars).withColumns({"_b": body, "_r": rng, "_hi": F.greatest(c.open, c.close), "_lo": F.least(c.open, c.close)})
    past = lambda n: ts.by_symbol().rowsBetween(-n, -1)
    b = b.withColumns({"_ab": F.avg("_b").over(past(10)), "_ar": F.avg("_r").over(past(10)), "_a5": F.avg("_r").over(past(5))})
    b = b.withColumns(
        {f"_{x}{k}": F.lag(src, k).over(ts.by_symbol()) for k in (1, 2) for x, src in
         (("o", "open"), ("c", "close"), ("h", "_hi"), ("l", "_lo"), ("bd", "_b"), ("w", "low"), ("m", "_ab"), ("q", "_a5"))}
    )
    return candle_labels(b).drop(*[x for x in b.columns if x.startswith("_") and x not in bars.columns])


def candle_aggs() -> dict[str, Column]:
    """What :func:`candle_labels` reads of the bars before the last one, as aggregates over bars by age."""
    age, body, rng = ts.age(), F.abs(c.close - c.open), c.high - c.low
    at = lambda k, x: F.max(F.when(age == k, x))
    mean = lambda lo, hi, x: F.avg(F.when(age.between(lo, hi), x))
    high, low = F.greatest(c.open, c.close), F.least(c.open, c.close)
    past = {k: {"o": c.open, "c": c.close, "h": high, "l": low, "bd": body, "w": c.low} for k in (1, 2)}
    return {
        "_ab": mean(1, 10, body), "_ar": mean(1, 10, rng), "_m1": mean(2, 11, body), "_m2": mean(3, 12, body), "_q1": mean(2, 6, rng),
        **{f"_{x}{k}": at(k, src) for k, cols in past.items() for x, src in cols.items()},
    }


def candle_latest(per_symbol: DataFrame) -> DataFrame:
    """:func:`candles` of the last bar, from its own prices and :func:`candle_aggs`."""
    own = {"_b": F.abs(c.close - c.open), "_hi": F.greatest(c.open, c.close), "_lo": F.least(c.open, c.close)}
    return candle_labels(per_symbol.withColumns(own)).drop(*own, *candle_aggs())


def candle_labels(b: DataFrame) -> DataFrame:
    g = lambda k: F.col(f"_{k}")
    upper, lower = c.high - g("hi"), g("lo") - c.low
    white, black1 = c.close >= c.open, g("c1") < g("o1")
    doji = (c.bn >= 10) & (g("b") <= 0.1 * g("ar"))
    bull = white & black1 & (c.close > g("o1")) & (c.open < g("c1"))
    bear = (c.close < c.open) & (g("c1") >= g("o1")) & (c.open > g("c1")) & (c.close < g("o1"))
    small = g("b") < g("ab")
    hammer = (c.bn >= 11) & small & (lower > g("b")) & (upper < 0.1 * g("ar")) & (g("lo") <= g("w1") + 0.2 * g("q1"))
    star = (c.bn >= 11) & small & (upper > g("b")) & (lower < 0.1 * g("ar")) & (g("lo") > g("h1"))
    morning = (
        (c.bn >= 12) & (g("bd2") > g("m2")) & (g("c2") < g("o2")) & (g("bd1") <= g("m1")) & (g("h1") < g("l2"))
        & (g("b") > g("ab")) & white & (c.close > g("c2") + 0.3 * g("bd2"))
    )
    hit = lambda cond, name: F.when(truth(cond), name)
    names = F.concat_ws(
        ", ",
        hit(doji, "Doji"),
        F.coalesce(hit((c.bn >= 2) & bull, "Bullish Engulfing"), hit((c.bn >= 2) & bear, "Bearish Engulfing")),
        hit(hammer, "Hammer"), hit(star, "Shooting Star"), hit(morning, "Morning Star"),
    )
    return b.withColumn("candle_pattern", F.when(names == "", "None").otherwise(names))


KNN_FEATURES = ["rsi_14", "adx_14", "cci_14", "macd_hist"]


def knn_columns(panel: DataFrame, rows: int = 2000) -> DataFrame:
    """L1 distance of each bar to the latest one on min-max scaled features.

    Range and reference values are window values of the symbol, so no self-join.
    """
    p = ts.position(panel)
    ready = all_present(*[F.col(f) for f in KNN_FEATURES]) & (ts.age() < rows)
    parts = {}
    for f in KNN_FEATURES:
        x = F.when(ready, F.col(f))
        spread = F.max(x).over(ts.whole()) - F.min(x).over(ts.whole())
        latest = F.max(F.when(ts.age() == 0, x)).over(ts.whole())
        parts[f] = F.when(ready, F.coalesce(F.abs(sdiv(F.col(f) - latest, spread)), F.lit(0.0)))
    return p.withColumn("_dist", sum(parts.values(), F.lit(0.0)))


def knn_aggs(literal: bool = False) -> dict[str, Column]:
    """At most 2000 (distance, age, went up) entries; ``literal`` keeps the latest bar, whose label is always down."""
    entry = F.struct(F.col("_dist").alias("d"), ts.age().alias("age"), F.col("_up").alias("up"))
    use = F.col("_dist").isNotNull() & (F.lit(True) if literal else ts.age() > 0)
    return {"_kn": F.array_sort(F.collect_list(F.when(use, entry))), "_kv": F.count("_dist"), "_kb": F.count(F.lit(1))}


def knn_labels(per_symbol: DataFrame, k: int = 8, min_bars: int = 50, min_rows: int = 20) -> DataFrame:
    near = F.slice("_kn", 1, k)
    same = F.filter(near, lambda x: x["d"] == 0)
    add = lambda arr, fn: F.aggregate(arr, F.lit(0.0), lambda a, x: a + fn(x))
    up = lambda x: x["up"].cast("double")
    share = F.when(F.size(same) > 0, sdiv(add(same, up), F.size(same))).otherwise(
        sdiv(add(near, lambda x: up(x) / x["d"]), add(near, lambda x: 1.0 / x["d"]))
    )
    s = per_symbol.withColumn("knn_up", share)
    ok = (F.col("_kb") >= min_bars) & (F.col("_kv") >= min_rows) & (c.knn_up > 0.5)
    return s.withColumn("knn_action", _act(truth(ok), "Lorentzian Buy", "No Signal")).drop("_kn", "_kv", "_kb")


def went_up() -> Column:
    """1 when the next close is higher, 0 otherwise (also on the last bar)."""
    return truth(F.lead("close").over(ts.by_symbol()) > c.close).cast("int")


def knn_direction(panel: DataFrame, k: int = 8, rows: int = 2000, literal: bool = False) -> DataFrame:
    """Direction vote of the ``k`` bars most similar to the latest bar, per symbol."""
    return knn_labels(_agg(knn_columns(panel.withColumn("_up", went_up()), rows), knn_aggs(literal)), k)
