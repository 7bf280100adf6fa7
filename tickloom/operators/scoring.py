"""Seven-factor composite score.  Missing inputs score as failed comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import bands, c, clip, flag
from ..functions.rank import min_rank

# fixed values: factor weights
WEIGHTS = {"trend": 0.25, "momentum": 0.20, "car": 0.15, "risk": 0.15, "volume": 0.10, "volatility": 0.10, "catalyst": 0.05}


def _ladder(x: Column, cuts: list[float], op: str = ">=") -> Column:
    return bands(x, list(zip(cuts, (50.0, 35.0, 15.0))), 0.0, op)


def factors(t: DataFrame) -> DataFrame:
    order = [c.close, c.sma_20, c.sma_50, c.sma_100, c.sma_150, c.sma_200]
    stack = F.lit(0.0)
    for a, b in zip(order, order[1:]):
        stack = stack + flag(a > b, 10.0)
    near = F.when(c.diff_200 > 0, _ladder(c.diff_200, [10.0, 20.0, 30.0], "<=")).otherwise(0.0)
    rsi = (
        F.when(c.rsi_14.between(55, 70), 50.0).when((c.rsi_14 >= 45) & (c.rsi_14 < 55), 30.0)
        .when((c.rsi_14 > 70) & (c.rsi_14 <= 80), 20.0).when((c.rsi_14 >= 35) & (c.rsi_14 < 45), 10.0).otherwise(0.0)
    )
    up = c.plus_di_14 > c.minus_di_14
    di = F.when(up, F.when(c.adx_14 > 25, 50.0).when(c.adx_14 > 20, 35.0).otherwise(15.0)).otherwise(0.0)
    return t.withColumns(
        {
            "trend_score": stack + near,
            "momentum_score": rsi + di,
            "car_score": F.when(c.car_rating == "Buy/Average Out", 100.0).otherwise(20.0),
            "risk_score": _ladder(c.sharpe_1y, [2.0, 1.0, 0.5]) + _ladder(F.abs(c.max_drawdown_pct), [10.0, 20.0, 35.0], "<="),
            "volume_score": _ladder(c.deliv_pct, [45.0, 30.0, 20.0]) + _ladder(c.vol_spike, [2.5, 1.5, 1.0]),
            "volatility_score": bands(c.garch_vol_pct, [(20.0, 100.0), (35.0, 75.0), (50.0, 40.0)], 10.0, "<="),
            "catalyst_score": clip(30.0 + flag(c.insider_score > 0, 40.0) + F.when((c.event_days > 0) & (c.event_days <= 10), 30.0).otherwise(10.0), 0.0, 100.0),
        }
    )


def composite(t: DataFrame) -> DataFrame:
    total = F.lit(0.0)
    for f, w in WEIGHTS.items():
        total = total + F.col(f"{f}_score") * w
    return factors(t).withColumn("composite_score", total)


def ranked(t: DataFrame) -> DataFrame:
    """Composite score with rank 1 for the best; equal scores share the best rank."""
    return min_rank(composite(t), "composite_score", "rank")
