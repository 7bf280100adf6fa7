"""Risk and quantitative metrics per symbol.

All of them are conditional aggregates over columns of one (symbol, date) window
pass; the number of bars of a symbol is bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, money, rnd, sdiv
from . import garch

YEAR = 252


def _prep(bars: DataFrame, lookback: int) -> DataFrame:
    b = ts.position(bars.filter(c.close.isNotNull()))
    b = b.withColumn("_lr", ts.log_return(c.close))
    inside = ts.age() < lookback
    peak = F.max(F.when(inside, c.close)).over(ts.sofar())
    return b.withColumn("_dd", F.when(inside, (c.close - peak) / peak * 100.0))


def risk_table(bars: DataFrame, lookback: int = YEAR, risk_free: float = 0.06, min_obs: int = 30) -> DataFrame:
    """Max drawdown, Sharpe, Calmar and historical VaR of the last ``lookback`` bars in one pass."""
    b = _prep(bars, lookback)
    lr, rf = F.col("_lr"), risk_free / YEAR
    tail, ret = ts.age() < lookback, F.when(ts.age() < lookback, lr)
    var_ret = F.when(ts.age() < lookback - 1, lr)
    g = b.groupBy("symbol").agg(
        F.max("n_bars").alias("n"),
        F.min("_dd").alias("dd"),
        F.count(ret).alias("nr"), F.avg(ret).alias("mu"), F.stddev_samp(ret).alias("sd"),
        F.min_by(F.when(tail, c.close), F.when(tail, c.bn)).alias("start"),
        F.max_by("close", "bn").alias("end"),
        F.count(var_ret).alias("nv"), F.percentile(var_ret, F.lit(0.05)).alias("p05"),
    )
    days = F.least(c.n, F.lit(lookback))
    cagr = F.pow(c.end / c.start, F.lit(float(YEAR)) / days) - 1
    return g.select(
        "symbol",
        F.when(c.n >= 2, c.dd).alias("max_drawdown_pct"),
        F.when((c.nr >= min_obs) & (c.n > min_obs) & (c.sd > 0), rnd((c.mu - rf) / c.sd * math.sqrt(YEAR), 4)).alias("sharpe_1y"),
        F.when((days >= 2) & (c.start > 0) & (c.end > 0) & (c.dd != 0), rnd(cagr / F.abs(c.dd / 100.0), 4)).alias("calmar_1y"),
        F.when(c.nv >= 5, rnd(F.abs(c.p05) * 100.0, 4)).alias("var_95_pct"),
    )


def beta(bars: DataFrame, bench: DataFrame, lookback: int = YEAR, min_obs: int = 30) -> DataFrame:
    """Covariance over variance of aligned log returns of the last closes of symbol and benchmark.

    ``bench(date, bench)`` has one row per calendar day, so it is broadcast.
    """
    # newest dates of the benchmark: a top-k, not a sort of the whole series in one task
    recent = bench.filter("bench is not null").orderBy(F.desc("date")).limit(lookback + 1)
    b = ts.tail(bars.filter(c.close.isNotNull()), lookback + 1).join(F.broadcast(recent), "date")
    b = b.withColumns({"_rs": ts.log_return(c.close), "_rb": ts.log_return(c.bench)})
    g = b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("_rs").alias("nr"),
        F.covar_samp("_rs", "_rb").alias("cov"),
        F.var_samp(F.when(F.col("_rs").isNotNull(), F.col("_rb"))).alias("var"),
    )
    return g.select("symbol", F.when((c.n >= min_obs) & (c.nr >= min_obs), rnd(sdiv(c.cov, F.col("var")), 4)).alias("beta"))


def risk_badge(t: DataFrame) -> DataFrame:
    """One-line text: badge by Sharpe, then the metrics that exist."""
    part = lambda name, x, unit="": F.when(x.isNotNull(), F.concat(F.lit(name + "="), money(x), F.lit(unit)))
    icon = F.when(c.sharpe_1y >= 1.5, "⭐").when(c.sharpe_1y >= 0.5, "📊").otherwise("⚠️ ")
    text = F.concat_ws(
        " | ", c.symbol, part("Sharpe", c.sharpe_1y), part("Calmar", c.calmar_1y), part("Beta", c.beta), part("MaxDD", c.max_drawdown_pct, "%")
    )
    return t.withColumn("risk_badge", F.concat(icon, F.lit(" "), text))


def _slope(xs: list[float], ys: list[Column]) -> Column:
    """Least-squares slope through (x, y) for the y that are not NULL."""
    def tot(fn) -> Column:
        out = F.lit(0.0)
        for x, y in zip(xs, ys, strict=True):  # plain sums: a lambda over an array is interpreted, once for each place that names it
            out = out + F.when(y.isNotNull(), fn(F.lit(x), y)).otherwise(0.0)
        return out

    n = tot(lambda x, y: F.lit(1.0))
    mx = tot(lambda x, y: x) / n
    sxx = tot(lambda x, y: x * x) - n * mx * mx
    sxy = tot(lambda x, y: x * y) - mx * tot(lambda x, y: y)
    return F.when(n >= 2, sdiv(sxy, sxx))


def hurst(bars: DataFrame, lags: int = 20) -> DataFrame:
    """Hurst exponent per symbol: slope of ln(std of lagged log-price differences) on ln(lag), clipped to 0..1."""
    b = bars.filter(c.close > 0).withColumn("_lp", F.log("close"))
    ks = list(range(2, lags))
    b = b.withColumns({f"_d{k}": ts.diff(F.col("_lp"), k) for k in ks})
    g = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.stddev_samp(f"_d{k}").alias(f"s{k}") for k in ks])
    s = _slope([math.log(k) for k in ks], [F.when(F.col(f"s{k}") > 0, F.log(f"s{k}")) for k in ks])
    return g.filter(c.n >= lags + 5).select(
        "symbol", F.coalesce(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("hurst")
    )


def hurst_label(h: Column) -> Column:
    kind = F.when(h > 0.6, "Trending").when(h < 0.4, "Mean-reverting").otherwise("Random walk")
    return kind


def rolling_hurst(bars: DataFrame, n: int = 20, lags: int = 5) -> DataFrame:
    """Hurst of the ``n`` closes before each bar (lags 2..lags-1); 0.5 while there are fewer."""
    lp = F.log("close")
    ks = range(2, lags)
    b = ts.position(bars).withColumns({f"_d{k}": ts.diff(lp, k) for k in ks})
    # the n closes before a bar hold n-k differences of lag k
    b = b.withColumns({f"_s{k}": F.stddev_samp(f"_d{k}").over(ts.by_symbol().rowsBetween(-(n - k), -1)) for k in ks})
    b = b.withColumns({f"_y{k}": F.when(F.col(f"_s{k}") > 0, F.log(f"_s{k}")) for k in ks})
    s = _slope([math.log(k) for k in ks], [F.col(f"_y{k}") for k in ks])
    h = F.when(c.bn >= n, F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))
    drop = [x for x in ("bn", "n_bars") if x not in bars.columns]
    return b.withColumn(f"hurst_{n}", F.coalesce(h, F.lit(0.5))).drop(*drop, *[f"_{p}{k}" for p in "dsy" for k in ks])


def vol_regime(bars: DataFrame, high: float = 35.0, low: float = 15.0, min_obs: int = 60) -> DataFrame:
    """GARCH(1,1) conditional volatility of the last bar (see ``garch``) and its regime; "Unknown" without a fit."""
    vol = rnd(c.sigma * math.sqrt(YEAR), 4)
    fit = garch.fitted(bars, min_obs).select("symbol", vol.alias("garch_vol_pct"))
    # a symbol with one bar has no return and so no row
    some = bars.groupBy("symbol").agg(F.count(F.when(c.close > 0, 1)).alias("_n")).filter("_n > 1").select("symbol")
    v = c.garch_vol_pct
    label = F.when(v.isNull(), "Unknown").when(v >= high, "High").when(v <= low, "Low").otherwise("Medium")
    return some.join(fit, "symbol", "left").select("symbol", v, label.alias("vol_regime"))


def correlation_matrix(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Correlations of daily returns of a given symbol list, on dates where all of them traded (and on the trading day before).

    The list is part of the request, so closes are pivoted to one row per calendar
    day and every pair is one aggregate over that table: no join, no pair rows.
    """
    wide = bars.filter(c.symbol.isin(symbols)).groupBy("date").pivot("symbol", symbols).agg(F.max("close"))
    w = W.orderBy("date")  # one row per calendar day
    ret = wide.select("date", *[(sdiv(F.col(f"`{s}`"), F.lag(F.col(f"`{s}`")).over(w)) - 1).alias(f"r{i}") for i, s in enumerate(symbols)])
    ret = ret.na.drop()
    n = len(symbols)
    pairs = [(i, j) for i in range(n) for j in range(n)]
    agg = ret.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs if i < j])
    cell = lambda i, j: F.when(F.col("_n") > 1, 1.0) if i == j else F.col(f"c{min(i, j)}_{max(i, j)}")
    rows = F.array(*[F.struct(F.lit(symbols[i]).alias("symbol_a"), F.lit(symbols[j]).alias("symbol_b"), cell(i, j).alias("corr")) for i, j in pairs])
    return agg.select(F.inline(rows))


def held_correlation(bars: DataFrame, held: list[str], lookback: int = 30, limit: float = 0.8) -> DataFrame:
    """Highest correlation of each symbol's last returns with any held symbol; ``accepted`` if none is above ``limit``.

    The portfolio is a short given list: its returns become one column per holding on
    a table of at most ``lookback * len(held)`` days, broadcast to all candidates.
    """
    r = ts.tail(bars.withColumn("ret", ts.pct_change(c.close)).withColumn("_nb", F.count(F.lit(1)).over(ts.whole())), lookback)
    r = r.filter(F.col("_nb") >= lookback)
    mine = r.filter(c.symbol.isin(held)).groupBy("date").pivot("symbol", held).agg(F.max("ret"))
    mine = mine.select("date", *[F.col(f"`{h}`").alias(f"_h{i}") for i, h in enumerate(held)])
    j = r.filter(~c.symbol.isin(held)).join(F.broadcast(mine), "date", "left")
    g = j.groupBy("symbol").agg(*[F.corr("ret", f"_h{i}").alias(f"c{i}") for i in range(len(held))])
    best = F.array_max(F.array(*[F.col(f"c{i}") for i in range(len(held))]))
    return g.select("symbol", best.alias("max_corr"), F.coalesce(best <= limit, F.lit(True)).alias("accepted"))
