"""Indicators carried forward day by day.

A state row per symbol holds what the next bar needs and nothing else: the smoothed values and running sums of every
recursive indicator, and the last 253 bars for the plain windows. An update joins the state with the new bars only, so a
day costs one day's trades and one pass over the state, whatever the length of the history. The step from one bar to the
next is a column expression, so a batch of several days is a fold in the JVM.

Bars without a full set of prices, and bars on or before the state's date, change nothing; ``late_bars`` lists the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, sdiv
from .indicators import _EXTREMES, EMA_LENGTHS, SMA_LENGTHS, recursive

TAIL = 253  # the longest window, and one bar more for what looks a bar back
N, FAST, SLOW, SIG = 14, 12, 26, 9
_BAR = "struct<date:date,open:double,high:double,low:double,close:double,volume:double>"
_SUMS = ("all", "late", "tg", "td", "ttr", "tpdm", "tmdm", "ms", "xs")
_SMOOTHED = (*(f"ema_{m}" for m in EMA_LENGTHS), "fast", "slow", "wg", "wd", "wtr", "zpdm", "zmdm", "ztr", "sig", "adx")
_CARRY = f"struct<bn:int,date:date,close:double,high:double,low:double,{','.join(f'{k}:double' for k in (*_SUMS, *_SMOOTHED))}>"


def _bar() -> Column:
    return F.struct("date", *[F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close", "volume")])


def _whole(bars: DataFrame) -> DataFrame:
    return bars.filter("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")


def build_state(bars: DataFrame) -> DataFrame:
    """State (symbol, carry, tail) after the last bar of each symbol: one shuffle by symbol."""
    p = recursive(_whole(bars), internals=True)
    raw = {"ms": c._ms * SIG, "xs": c._xs * N, **{k: F.col(f"_{k}") for k in (*_SUMS[:7], "fast", "slow", "wg", "wd", "wtr", "zpdm", "zmdm", "ztr", "sig", "adx")}}
    raw |= {f"ema_{m}": F.col(f"ema_{m}") for m in EMA_LENGTHS}
    row = F.struct(c.bn.alias("bn"), "date", "close", "high", "low", *[raw[k].alias(k) for k in (*_SUMS, *_SMOOTHED)])
    last = F.first(F.when(ts.age() == 0, row), ignorenulls=True).cast(_CARRY)
    tail = F.array_sort(F.collect_list(F.when(ts.age() < TAIL, _bar())))
    return p.groupBy("symbol").agg(last.alias("carry"), tail.cast(f"array<{_BAR}>").alias("tail"))


def _step(s: Column, b: Column) -> Column:
    """The carry after one more bar."""
    bn = s["bn"] + 1
    x, zero = b["close"], F.lit(0.0)
    chg, up, dn = x - s["close"], b["high"] - s["high"], s["low"] - b["low"]
    g, d = F.greatest(chg, zero), F.greatest(-chg, zero)
    tr = F.greatest(b["high"] - b["low"], F.abs(b["high"] - s["close"]), F.abs(b["low"] - s["close"]))
    pdm = F.when((up > 0) & (up > dn), up).otherwise(0.0)
    mdm = F.when((dn > 0) & (dn > up), dn).otherwise(0.0)

    def summed(k: str, v: Column, first: int) -> Column:
        return F.when(bn >= first, F.coalesce(s[k], zero) + F.coalesce(v, zero))

    def average(k: str, first: int, alpha: float, v: Column, seed: Column) -> Column:
        return F.when(bn == first, seed).when(bn > first, alpha * F.coalesce(v, zero) + (1 - alpha) * s[k])

    def wilder(k: str, v: Column, total: Column) -> Column:
        return F.when(bn == N - 1, total).when(bn > N - 1, s[k] * ((N - 1) / N) + v)

    new: dict[str, Column] = {"all": summed("all", x, 0), "late": summed("late", x, SLOW - FAST)}
    for k, v in (("g", g), ("d", d), ("tr", tr), ("pdm", pdm), ("mdm", mdm)):
        new[f"t{k}"] = summed(f"t{k}", v, 1)
    for m in EMA_LENGTHS:
        new[f"ema_{m}"] = average(f"ema_{m}", m - 1, 2.0 / (m + 1), x, new["all"] / m)
    new["fast"] = average("fast", SLOW - 1, 2.0 / (FAST + 1), x, new["late"] / FAST)
    new["slow"] = average("slow", SLOW - 1, 2.0 / (SLOW + 1), x, new["all"] / SLOW)
    for k, v in (("g", g), ("d", d), ("tr", tr)):
        new[f"w{k}"] = average(f"w{k}", N, 1.0 / N, v, new[f"t{k}"] / N)
    for k, v in (("pdm", pdm), ("mdm", mdm), ("tr", tr)):
        new[f"z{k}"] = wilder(f"z{k}", v, new[f"t{k}"])
    mac, dx = F.when(bn >= SLOW - 1, new["fast"] - new["slow"]), F.when(bn >= N, _dx(new))
    new["ms"], new["xs"] = summed("ms", mac, SLOW - 1), summed("xs", dx, N)
    new["sig"] = average("sig", SLOW + SIG - 2, 2.0 / (SIG + 1), mac, new["ms"] / SIG)
    new["adx"] = average("adx", 2 * N - 1, 1.0 / N, dx, new["xs"] / N)
    return F.struct(bn.cast("int").alias("bn"), b["date"].alias("date"), x.alias("close"), b["high"].alias("high"), b["low"].alias("low"), *[new[k].cast("double").alias(k) for k in (*_SUMS, *_SMOOTHED)])


def _di(s, k: str) -> Column:
    return F.coalesce(100.0 * sdiv(s[k], s["ztr"]), F.lit(0.0))


def _dx(s) -> Column:
    p, m = _di(s, "zpdm"), _di(s, "zmdm")
    return F.when(p + m > 0, 100.0 * F.abs(p - m) / (p + m))


def _nothing() -> Column:
    return F.struct(F.lit(-1).alias("bn"), *[F.lit(None).alias(k) for k in ("date", "close", "high", "low", *_SUMS, *_SMOOTHED)]).cast(_CARRY)


def update_state(state: DataFrame, bars: DataFrame) -> DataFrame:
    """The state after the new bars: symbols without one keep theirs, new symbols begin one.

    ``bars`` are the new days only; a symbol has one bar a day, so a symbol's part of a batch is as long as the batch has days.
    """
    new = _whole(bars).groupBy("symbol").agg(F.array_sort(F.collect_list(_bar())).cast(f"array<{_BAR}>").alias("new"))
    j = state.join(new, "symbol", "full_outer")
    known = F.coalesce("new", F.array().cast(f"array<{_BAR}>"))
    j = j.withColumn("fresh", F.filter(known, lambda b: F.coalesce(b["date"] > c.carry["date"], F.lit(True))))
    whole = F.concat(F.coalesce("tail", F.array().cast(f"array<{_BAR}>")), c.fresh)
    tail = F.slice(whole, F.greatest(F.size(whole) - TAIL + 1, F.lit(1)), F.lit(TAIL))
    return j.select("symbol", F.aggregate("fresh", F.coalesce("carry", _nothing()), _step).alias("carry"), tail.alias("tail"))


def late_bars(state: DataFrame, bars: DataFrame) -> DataFrame:
    """New bars that an update passes over because the state is as late or later."""
    return bars.join(state.select("symbol", c.carry["date"].alias("state_date")), "symbol").filter(c.date <= c.state_date)


def _last(field: str, n: int, back: int = 0) -> Column:
    """The last ``n`` values of a field, ``back`` bars earlier; NULL with fewer bars."""
    size = F.size("tail")
    return F.when(size >= n + back, F.transform(F.slice("tail", size - (n + back - 1), F.lit(n)), lambda b: b[field]))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _mean(x: Column, n: int) -> Column:
    return _sum(x) / n


def panel_row(state: DataFrame) -> DataFrame:
    """Every indicator of the last bar of each symbol, from its state alone (the columns of ``indicators``)."""
    s, n = c.carry, F.size("tail")
    last = F.element_at("tail", -1)
    t = state.filter(n > 0).withColumns(
        {
            "_r": F.zip_with(_last("close", 20), _last("close", 20, 1), lambda a, b: sdiv(a, b) - 1),
            "_tp": F.when(n >= 14, F.transform(F.slice("tail", F.greatest(n - 13, F.lit(1)), F.lit(14)), lambda b: (b["high"] + b["low"] + b["close"]) / 3.0)),
            "_c": _last("close", 20),
            "prev_close": F.element_at(_last("close", 1, 1), 1),
            "close": last["close"],
        }
    ).withColumns({"_mu": _mean(c._r, 20), "_tm": _mean(c._tp, 14), "_m": _mean(c._c, 20)})
    t = t.withColumns(
        {
            "_rsd": F.sqrt(F.aggregate("_r", F.lit(0.0), lambda a, v: a + (v - c._mu) * (v - c._mu)) / 19.0),
            "_sd": F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, v: a + (v - c._m) * (v - c._m)) / 20.0),
            "_mad": F.aggregate("_tp", F.lit(0.0), lambda a, v: a + F.abs(v - c._tm)) / 14.0,
            "_dev": F.element_at("_tp", -1) - c._tm,
            "_va": _mean(_last("volume", 20), 20),
        }
    )
    bn, since = s["bn"], lambda first, x: F.when(bn >= first, x)
    den, mac = s["wg"] + s["wd"], s["fast"] - s["slow"]
    out = {
        **{f"sma_{m}": _mean(_last("close", m), m) for m in SMA_LENGTHS},
        **{k: (F.array_min if op == "min" else F.array_max)(_last(col, m)) for k, (op, col, m) in _EXTREMES.items()},
        "bb_middle": c._m, "bb_upper": c._m + 2.0 * c._sd, "bb_lower": c._m - 2.0 * c._sd,
        "z_score": F.coalesce(sdiv(F.element_at("_r", -1) - c._mu, c._rsd), F.lit(0.0)),
        "vol_spike": F.when(c._va > 0, last["volume"] / c._va).otherwise(0.0),
        "change_pct": F.when(c.prev_close > 0, (c.close - c.prev_close) * 100.0 / c.prev_close).otherwise(0.0),
        "cci_14": F.when(c._mad.isNotNull(), F.when((c._mad != 0) & (c._dev != 0), sdiv(c._dev, 0.015 * c._mad)).otherwise(0.0)),
        **{f"ema_{m}": since(m - 1, s[f"ema_{m}"]) for m in EMA_LENGTHS},
        "rsi_14": since(N, F.coalesce(100.0 * sdiv(s["wg"], den), F.lit(0.0))),
        "atr_14": since(N, s["wtr"]), "plus_di_14": since(N, _di(s, "zpdm")), "minus_di_14": since(N, _di(s, "zmdm")), "adx_14": since(2 * N - 1, s["adx"]),
        "macd": since(SLOW + SIG - 2, mac), "macd_signal": since(SLOW + SIG - 2, s["sig"]), "macd_hist": since(SLOW + SIG - 2, mac - s["sig"]),
        "prev_high_55": F.array_max(_last("high", 55, 1)), "prev_sma_100": _mean(_last("close", 100, 1), 100),
    }
    return t.select("symbol", last["date"].alias("date"), *[last[k].alias(k) for k in ("open", "high", "low")], "close", last["volume"].alias("volume"), bn.alias("bn"), "prev_close", *[v.alias(k) for k, v in out.items()])
