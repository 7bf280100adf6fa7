"""Technical indicators over bars.  Seeding follows the public TA-Lib definitions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recur, ts
from ..functions.num import c, flag, rnd, sdiv, truth
from ..functions.rolling import rolling

SMA_LENGTHS = (20, 50, 100, 150, 200)
EMA_LENGTHS = (20, 50, 100, 200)
_EXTREMES = {
    "low_20": ("min", "low", 20),
    "low_126": ("min", "low", 126),
    "low_200": ("min", "low", 200),
    "high_55": ("max", "high", 55),
    "high_252": ("max", "high", 252),
    "low_252": ("min", "low", 252),
}


def sma(bars: DataFrame, lengths: tuple[int, ...] = SMA_LENGTHS) -> DataFrame:
    return rolling(bars, {f"sma_{n}": ("mean", "close", n) for n in lengths})


# Each of the next three operators is a set of windows on raw bar columns plus a
# finishing projection, so that windows() can evaluate all of them in one operator.


def _bollinger_raw(n: int) -> dict[str, Column]:
    return {"bb_middle": ts.mean(c.close, n), "_bsd": ts.std_pop(c.close, n), "std_20": ts.std(c.close, n)}


def _bollinger_finish(b: DataFrame, width: float) -> DataFrame:
    return b.withColumns(
        {"bb_upper": c.bb_middle + width * F.col("_bsd"), "bb_lower": c.bb_middle - width * F.col("_bsd")}
    ).drop("_bsd")


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Middle = SMA, bands at ``width`` population deviations."""
    return _bollinger_finish(bars.withColumns(_bollinger_raw(n)), width)


def extremes(bars: DataFrame) -> DataFrame:
    """Rolling lows (20, 126, 200, 252 bars) and highs (55, 252 bars)."""
    return rolling(bars, _EXTREMES)


def _cci_raw(n: int) -> dict[str, Column]:
    return {f"_tp{i}": ts.lag(F.col("_tp"), i) for i in range(1, n)}


def _cci_finish(b: DataFrame, n: int) -> DataFrame:
    tps = [F.col(f"_tp{i}") for i in range(n - 1, 0, -1)] + [F.col("_tp")]
    b = b.withColumn("_tm", reduce(add, tps) / n)
    m, mad = F.col("_tm"), F.col("_mad")
    dev = F.col("_tp") - m
    b = b.withColumn("_mad", reduce(add, [F.abs(x - m) for x in tps]) / n)
    out = F.when(mad.isNotNull(), F.when((mad != 0) & (dev != 0), sdiv(dev, 0.015 * mad)).otherwise(0.0))
    return b.withColumn(f"cci_{n}", out).drop("_tp", *_cci_raw(n), "_tm", "_mad")


def cci(bars: DataFrame, n: int = 14) -> DataFrame:
    """(tp - mean) / (0.015 * mean absolute deviation) of the typical price; 0 when either part is 0."""
    return _cci_finish(with_typical_price(bars).withColumns(_cci_raw(n)), n)


def with_typical_price(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_tp", (c.high + c.low + c.close) / 3.0)


def _activity_raw(n: int) -> dict[str, Column]:
    return {"prev_close": ts.lag(c.close), "_r": ts.pct_change(c.close), "_va": ts.mean(c.volume, n)}


def _activity_finish(b: DataFrame, n: int) -> DataFrame:
    r = F.col("_r")
    return _activity_labels(b.withColumns({"_mu": ts.mean(r, n), "_rsd": ts.std(r, n)}))


def _activity_labels(b: DataFrame) -> DataFrame:
    r = F.col("_r")
    return b.withColumns(
        {
            "z_score": F.coalesce(sdiv(r - F.col("_mu"), F.col("_rsd")), F.lit(0.0)),
            "vol_spike": F.when(F.col("_va") > 0, c.volume / F.col("_va")).otherwise(0.0),
            "change_pct": F.when(c.prev_close > 0, (c.close - c.prev_close) * 100.0 / c.prev_close).otherwise(0.0),
        }
    ).drop("_r", "_va", "_mu", "_rsd")


def activity(bars: DataFrame, n: int = 20) -> DataFrame:
    """Daily change, return z-score and volume spike; 0 where they are not defined."""
    return _activity_finish(bars.withColumns(_activity_raw(n)), n)


def _true_range(prev: Column) -> Column:
    return F.greatest(c.high - c.low, F.abs(c.high - prev), F.abs(c.low - prev))


def recursive(bars: DataFrame, ema: tuple[int, ...] = EMA_LENGTHS, n: int = 14, macd: tuple[int, int, int] = (12, 26, 9), internals: bool = False) -> DataFrame:
    """EMA, RSI, MACD, ATR, DI and ADX in three shared stages of block-decayed sums.

    With ``internals`` the running sums and smoothed values behind them stay (names with a leading underscore). Stage 1 smooths prices, gains/losses, range and directional movement; stage 2
    the MACD signal and ADX, which read stage 1.
    """
    fast, slow, sig = macd
    had = set(bars.columns)
    b = recur.with_blocks(bars)
    bn = F.col("bn")
    # after the sort by blocks, so that it holds no column made here
    b = b.withColumns({f"_p{x[0]}": F.lag(x).over(recur.in_blocks()) for x in ("close", "high", "low")})
    chg, up, dn = c.close - F.col("_pc"), c.high - F.col("_ph"), F.col("_pl") - c.low
    b = b.withColumns(
        {
            "_g": F.greatest(chg, F.lit(0.0)),
            "_d": F.greatest(-chg, F.lit(0.0)),
            "_tr": F.when(bn > 0, _true_range(F.col("_pc"))),
            "_pdm": F.when((up > 0) & (up > dn), up).otherwise(0.0),
            "_mdm": F.when((dn > 0) & (dn > up), dn).otherwise(0.0),
        }
    )
    if internals:
        b = b.withColumns(
            {
                "_all": recur.run_sum(c.close, 0),
                "_late": recur.run_sum(c.close, slow - fast),
                **{f"_t{k}": recur.run_sum(F.col(f"_{k}"), 1) for k in ("g", "d", "tr", "pdm", "mdm")},
            }
        )
    w = (n - 1) / n

    def smoothed(x: Column, start: int, first: int, r: float, m: int, alpha: float) -> tuple[Column, float]:
        return recur.seed_shares(x, start, first, r, m).when(bn > first, F.lit(alpha) * x), r

    specs = {}
    for name, m, start, first in [(f"ema_{m}", m, 0, m - 1) for m in ema] + [("_fast", fast, slow - fast, slow - 1), ("_slow", slow, 0, slow - 1)]:
        a = 2.0 / (m + 1)
        specs[name] = smoothed(c.close, start, first, 1 - a, m, a)
    for k in ("g", "d", "tr"):
        specs[f"_w{k}"] = smoothed(F.col(f"_{k}"), 1, n, w, n, 1.0 / n)
    # Wilder sums: bars 1..n-1 add up, then S = S - S/n + x
    for k in ("pdm", "mdm", "tr"):
        specs[f"_z{k}"] = smoothed(F.col(f"_{k}"), 1, n - 1, w, 1, 1.0)
    b = recur.decay_sums(b, specs)

    pdi = F.coalesce(100.0 * sdiv(F.col("_zpdm"), F.col("_ztr")), F.lit(0.0))
    mdi = F.coalesce(100.0 * sdiv(F.col("_zmdm"), F.col("_ztr")), F.lit(0.0))
    den = F.col("_wg") + F.col("_wd")
    b = b.withColumns(
        {
            **{f"ema_{m}": recur.from_bar(F.col(f"ema_{m}"), m - 1) for m in ema},
            f"rsi_{n}": recur.from_bar(F.coalesce(100.0 * sdiv(F.col("_wg"), den), F.lit(0.0)), n),
            f"atr_{n}": recur.from_bar(F.col("_wtr"), n),
            f"plus_di_{n}": recur.from_bar(pdi, n),
            f"minus_di_{n}": recur.from_bar(mdi, n),
            "_macd": recur.from_bar(F.col("_fast") - F.col("_slow"), slow - 1),
        }
    )
    p, m_ = F.col(f"plus_di_{n}"), F.col(f"minus_di_{n}")
    b = b.withColumn("_dx", F.when(p + m_ > 0, 100.0 * F.abs(p - m_) / (p + m_)))
    first_adx, first_sig = 2 * n - 1, slow + sig - 2
    # DX is undefined only on a leading stretch without any movement, where ADX stays 0
    if internals:
        b = b.withColumns(
            {
                "_ms": recur.run_sum(F.col("_macd"), slow - 1) / sig,
                "_xs": recur.run_sum(F.coalesce(F.col("_dx"), F.lit(0.0)), n) / n,
            }
        )
    a = 2.0 / (sig + 1)
    b = recur.decay_sums(
        b,
        {
            "_sig": smoothed(F.col("_macd"), slow - 1, first_sig, 1 - a, sig, a),
            "_adx": smoothed(F.col("_dx"), n, first_adx, w, n, 1.0 / n),
        },
    )
    b = b.withColumns(
        {
            "macd": recur.from_bar(F.col("_macd"), first_sig),
            "macd_signal": recur.from_bar(F.col("_sig"), first_sig),
            "macd_hist": recur.from_bar(F.col("_macd") - F.col("_sig"), first_sig),
            f"adx_{n}": recur.from_bar(F.col("_adx"), first_adx),
        }
    )
    if internals:
        return b
    keep = [k for k in b.columns if k in had or not (k.startswith("_") or k in ("bn", "n_bars"))]
    return b.select(*keep)


def windows(bars: DataFrame) -> DataFrame:
    """The indicators that are plain windows, all on the (symbol, date) order."""
    b = with_typical_price(bars).withColumns({"bn": ts.bar_no(), **_activity_raw(20), **_bollinger_raw(20), **_cci_raw(14)})
    b = _bollinger_finish(_cci_finish(b, 14), 2.0)
    b = _activity_finish(b, 20).withColumn("n_bars", F.count(F.lit(1)).over(ts.whole()))
    b = rolling(b, {**{f"sma_{n}": ("mean", "close", n) for n in SMA_LENGTHS}, **_EXTREMES, "high_20": ("max", "high", 20)})
    return b.withColumns({"prev_high_55": ts.lag(c.high_55), "prev_sma_100": ts.lag(c.sma_100)})


def indicators(bars: DataFrame) -> DataFrame:
    """Every indicator column at once: one shuffle by symbol feeds all windows.

    The recursive ones come first: their blocks need a sort of their own, of rows that are still narrow.
    """
    return windows(recursive(bars))


def latest_columns(bars: DataFrame) -> DataFrame:
    """The per-bar columns behind :func:`latest_aggs`: position, return and CCI."""
    return cci(with_typical_price(ts.position(bars.withColumn("_r", ts.pct_change(c.close)))))


def latest_aggs() -> dict[str, Column]:
    """Windows of :func:`windows` and averages of :func:`recursive` at the last bar only, as aggregates over bars by age.

    A row carries no window columns; an exponential average at the last bar is one weighted sum.
    """
    age, bn, n_bars = ts.age(), F.col("bn"), F.col("n_bars")

    def back(fn, x: Column, n: int, skip: int = 0) -> Column:
        x = F.when(age.between(skip, skip + n - 1), x)
        return F.when(F.count(x) == n, fn(x))

    def ema(m: int) -> Column:
        a = 2.0 / (m + 1)
        share = F.when(bn < m, F.pow(F.lit(1 - a), n_bars - m) / m).otherwise(F.lit(a) * F.pow(F.lit(1 - a), age))
        return F.when(F.max(bn) >= m - 1, F.sum(share * c.close))

    mean = lambda x: F.sum(x) / F.count(x)
    pick = {"min": F.min, "max": F.max}
    return {
        "prev_close": F.max(F.when(age == 1, c.close)),
        "bb_middle": back(F.avg, c.close, 20),
        "_bsd": back(F.stddev_pop, c.close, 20),
        "std_20": back(F.stddev_samp, c.close, 20),
        "_va": back(F.avg, c.volume, 20),
        "_mu": back(F.avg, F.col("_r"), 20),
        "_rsd": back(F.stddev_samp, F.col("_r"), 20),
        **{f"sma_{n}": back(mean, c.close, n) for n in SMA_LENGTHS},
        **{k: back(pick[op], F.col(x), n) for k, (op, x, n) in {**_EXTREMES, "high_20": ("max", "high", 20)}.items()},
        "prev_high_55": back(F.max, c.high, 55, 1),
        "prev_sma_100": back(mean, c.close, 100, 1),
        **{f"ema_{m}": ema(m) for m in EMA_LENGTHS},
    }


def latest_finish(per_symbol: DataFrame) -> DataFrame:
    """The rest of the last bar's columns, from its own ``_r`` and the aggregates."""
    return _activity_labels(_bollinger_finish(per_symbol, 2.0))


def last_row(columns: list[str]) -> Column:
    """The last bar's columns as one struct; the wide row is built for that bar only."""
    return F.first(F.when(ts.age() == 0, F.struct(*columns)), ignorenulls=True)


def latest_indicators(bars: DataFrame) -> DataFrame:
    """``ts.latest(indicators(bars))`` without the window columns of earlier bars."""
    p = recursive(latest_columns(bars), ema=())
    aggs = latest_aggs()
    s = p.groupBy("symbol").agg(last_row([x for x in p.columns if x not in ("symbol", "n_bars", "bn")]).alias("_last"), *[v.alias(k) for k, v in aggs.items()])
    return latest_finish(s.select("symbol", "_last.*", *aggs))


def divergence_aggs(lookback: int = 20) -> dict[str, Column]:
    """Aggregates of :func:`divergence_labels`: the last ``lookback`` bars of the symbol, no more."""
    bar = F.struct("bn", "close", F.col("rsi_14").alias("r"), F.col("macd_hist").alias("m"))
    return {"_dv": F.array_sort(F.collect_list(F.when(ts.age() < lookback, bar)))}


def divergence_labels(per_symbol: DataFrame, lookback: int = 20) -> DataFrame:
    """First lowest (highest) close after the middle against the one before it, and the same bars of the indicator."""
    per_symbol = per_symbol.withColumn("_p", F.col("_dv.close"))
    half = lookback // 2

    def label(field: str) -> Column:
        def side(pick, low: bool) -> Column:
            at = (F.array_position("_p", pick("_p")) - 1).cast("int")
            earlier = F.slice("_p", F.lit(1), F.greatest(at, F.lit(1)))
            prev_at = (F.array_position(earlier, pick(earlier)) - 1).cast("int")
            now, then = F.get("_dv", at), F.get("_dv", prev_at)
            if low:
                cond = (now["close"] < then["close"]) & (now[field] > then[field])
            else:
                cond = (now["close"] > then["close"]) & (now[field] < then[field])
            return truth((F.size("_p") == lookback) & (at > half) & cond)

        return F.when(side(F.array_max, False), "Bearish").when(side(F.array_min, True), "Bullish").otherwise("None")

    return per_symbol.withColumns({"rsi_divergence": label("r"), "macd_divergence": label("m")}).drop("_dv", "_p")


def divergence(panel: DataFrame, lookback: int = 20) -> DataFrame:
    """Latest-bar RSI and MACD-histogram divergence over the last ``lookback`` bars, per symbol."""
    aggs = divergence_aggs(lookback)
    return divergence_labels(ts.position(panel).groupBy("symbol").agg(*[v.alias(k) for k, v in aggs.items()]), lookback)


def tech_score(panel: DataFrame) -> DataFrame:
    """0-100 score (trend 35, RSI 25, MACD 20, bands 10, ADX 10) and its rating."""
    px, e20, s50, s200 = c.close, c.ema_20, c.sma_50, c.sma_200
    rsi, up, mid, low, adx = (F.col(x) for x in ("rsi_14", "bb_upper", "bb_middle", "bb_lower", "adx_14"))
    score = (
        flag(px > e20, 5) + flag(px > s50, 10) + flag(px > s200, 10) + flag(e20 > s50, 5) + flag(s50 > s200, 5)
        + F.when(rsi.between(50, 70), 25).when(rsi > 70, 10).when(rsi >= 40, 15).when(rsi >= 30, 5).otherwise(0)
        + flag(F.col("macd") > F.col("macd_signal"), 20)
        + F.when(up.isNull(), 0).when((px >= mid) & (px <= up), 10).when((px >= low) & (px < mid), 5).when(px > up, 8).otherwise(0)
        + F.when(adx > 25, flag(px > s50, 10)).when(adx <= 25, 5).otherwise(0)
    )
    s = F.col("tech_score")
    return panel.withColumn("tech_score", score).withColumn(
        "tech_rating",
        F.when(s >= 80, "STRONG BUY").when(s >= 60, "BUY").when(s >= 40, "NEUTRAL").when(s >= 20, "SELL").otherwise("STRONG SELL"),
    )



def latest_labels(snap: DataFrame) -> DataFrame:
    """Dashboard labels of the latest bar: moving-average side, RSI, MACD, band, ADX, ATR and CCI zones."""
    side = lambda m: F.when(F.col(m).isNull(), "N/A").when(c.close > F.col(m), "ABOVE").otherwise("BELOW")
    zone = lambda x, *cases, last: _zone(F.col(x), cases, last)
    width = c.bb_upper - c.bb_lower
    return snap.select(
        "symbol",
        *[side(m).alias(f"vs_{m}") for m in ("ema_20", "sma_50", "sma_200")],
        zone("rsi_14", (c.rsi_14 >= 70, "OVERBOUGHT"), (c.rsi_14 <= 30, "OVERSOLD"), (c.rsi_14 >= 50, "BULLISH"), (c.rsi_14 >= 40, "NEUTRAL-BULLISH"), last="BEARISH").alias("rsi_zone"),
        zone("macd_hist", (c.macd > c.macd_signal, "BULLISH"), last="BEARISH").alias("macd_state"),
        F.when(width > 0, rnd((c.close - c.bb_lower) / width * 100, 1)).alias("bb_position_pct"),
        zone("adx_14", (c.adx_14 > 25, "STRONG"), last="WEAK").alias("adx_state"),
        rnd(c.atr_14 / c.close * 100, 2).alias("atr_pct"),
        zone("cci_14", (c.cci_14 >= 100, "OVERBOUGHT"), (c.cci_14 <= -100, "OVERSOLD"), last="NEUTRAL").alias("cci_zone"),
    )


def _zone(x: Column, cases: tuple, last: str) -> Column:
    out = F.when(x.isNull(), "N/A")
    for cond, label in cases:
        out = out.when(cond, label)
    return out.otherwise(last)
