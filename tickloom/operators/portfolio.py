"""Position sizing, trade costs, exposure, exits and rule positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, rnd, sdiv, truth


def position_size(t: DataFrame, capital: float = 500_000.0, risk: float = 0.01, atr_mult: float = 1.5) -> DataFrame:
    """Quantity that risks ``risk`` of the capital down to an ATR stop, with the 1:2 target."""
    ok = (c.close > 0) & (c.atr_14 > 0)
    stop = atr_mult * c.atr_14
    qty = F.floor(sdiv(F.lit(capital * risk), stop)).cast("double")
    only = lambda x: F.when(ok, x)
    return t.withColumns(
        {
            "suggested_qty": only(qty),
            "stop_price": only(rnd(c.close - stop, 2)),
            "risk_amount": only(F.lit(round(capital * risk, 2))),
            "position_value": only(rnd(qty * c.close, 2)),
            "rr_target": only(rnd(c.close + 2.0 * stop, 2)),
        }
    )


# fixed values: charge rates of a delivery trade as fractions of its value
EXCHANGE_RATE, REGULATOR_RATE, TRANSACTION_TAX, STAMP_DUTY, SERVICE_TAX = 0.0000345, 0.000001, 0.001, 0.00015, 0.18


def trade_cost(price: Column, qty: Column, side: Column) -> Column:
    value = price * qty
    stamp = F.when(F.upper(side) == "BUY", STAMP_DUTY).otherwise(0.0)
    rate = EXCHANGE_RATE * (1 + SERVICE_TAX) + REGULATOR_RATE + TRANSACTION_TAX + stamp
    return F.when(value > 0, value * rate).otherwise(0.0)


def position_table(p: DataFrame) -> DataFrame:
    """Value, profit and profit percent of each open position."""
    cost = c.qty * c.entry_price
    value = c.qty * c.current_price
    return p.withColumns(
        {
            "current_value": rnd(value, 2),
            "pnl": rnd(value - cost, 2),
            "pnl_pct": rnd(F.when(c.entry_price > 0, (value - cost) / cost * 100.0).otherwise(0.0), 2),
        }
    )


def _total(p: DataFrame, cash: float) -> DataFrame:
    return p.agg((F.coalesce(F.sum(c.qty * c.current_price), F.lit(0.0)) + cash).alias("total"))


def sector_exposure(p: DataFrame, cash: float, sector_cap: float = 0.25) -> DataFrame:
    """Value per sector, share of the whole portfolio, and whether it breaches the cap."""
    s = p.groupBy(F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.sum(c.qty * c.current_price).alias("exposure"))
    s = s.join(F.broadcast(_total(p, cash)), F.lit(True))  # the total is one row
    return s.withColumn("share", sdiv(c.exposure, c.total)).withColumn("breach", truth(c.share > sector_cap)).drop("total")


def single_exposure(p: DataFrame, cash: float, cap: float = 0.10) -> DataFrame:
    """Share of each position; ``breach`` above the single-position cap."""
    v = p.withColumn("value", c.qty * c.current_price)
    t = _total(p, cash)
    return v.join(F.broadcast(t), F.lit(True)).withColumn("share", sdiv(c.value, c.total)).withColumn("breach", truth(c.share > cap)).drop("total")


def heat(p: DataFrame, cash: float) -> DataFrame:
    """Cash at risk between price and stop over the total value."""
    risk = F.when(c.entry_price > c.stop_price, (c.entry_price - c.stop_price) * c.qty).otherwise(0.0)
    return p.agg(
        F.sum(risk).alias("at_risk"), (F.sum(c.qty * c.current_price) + cash).alias("total")
    ).select("at_risk", "total", F.when(c.total > 0, c.at_risk / c.total).otherwise(0.0).alias("heat"))


def exit_flags(p: DataFrame, quotes: DataFrame) -> DataFrame:
    """Stop hit (checked first) or target reached at the quoted price."""
    j = p.join(quotes.select("symbol", F.col("close").alias("cmp")), "symbol", "left")
    return j.withColumn(
        "exit_reason", F.when(c.cmp <= c.stop_price, "Stop Loss Triggered").when(c.cmp >= c.target_price, "Target Reached").otherwise("Hold")
    )


def rule_position(bars: DataFrame, entry: Column, exit_: Column, name: str = "position") -> DataFrame:
    """Long (1) / flat (0) state from entry and exit conditions without a fold.

    A bar with only one of the two sets the state; a bar with both flips it (flat
    enters, long leaves).  So the state is the last one-sided event, flipped once
    per two-sided bar since.
    """
    return rule_positions(bars, {name: (entry, exit_)})


def rule_positions(bars: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """:func:`rule_position` of several rules by column name, in two window operators for all of them."""
    raw, flips, at, state = {}, {}, {}, {}
    for k, (entry, exit_) in rules.items():
        e, x = truth(entry), truth(exit_)
        raw |= {f"_set_{k}": F.when(e & ~x, 1).when(x & ~e, 0), f"_flip_{k}": (e & x).cast("int")}
        flips[f"_flips_{k}"] = F.sum(f"_flip_{k}").over(ts.sofar())
        last = lambda col: F.last(F.when(F.col(f"_set_{k}").isNotNull(), F.col(col)), ignorenulls=True).over(ts.sofar())  # noqa: E731, B023
        at |= {f"_at_{k}": last(f"_set_{k}"), f"_from_{k}": last(f"_flips_{k}")}
        state[k] = ((F.coalesce(F.col(f"_at_{k}"), F.lit(0)) + F.col(f"_flips_{k}") - F.coalesce(F.col(f"_from_{k}"), F.lit(0))) % 2).cast("int")
    return bars.withColumns(raw).withColumns(flips).withColumns(at).withColumns(state).drop(*raw, *flips, *at)


def rules() -> dict[str, tuple[Column, Column]]:
    """Entry and exit conditions of the explorable rules (panel columns)."""
    px = c.close
    return {
        "turtle": (px >= c.prev_high_55, px <= c.low_20),
        "sma100": (px > c.sma_100, px < c.sma_100),
        "rdx": ((c.adx_14 > 25) & (c.plus_di_14 > c.minus_di_14) & (c.rsi_14 > 60), (c.plus_di_14 < c.minus_di_14) | (c.rsi_14 < 45)),
        "rsi": (c.rsi_14 < 30, c.rsi_14 > 50),
        "dmadma": ((px > c.sma_200) & (c.sma_200 > c.sma_150), px < c.sma_200),
    }


def strategy_vs_hold(bars: DataFrame, position: str = "position") -> DataFrame:
    """Compound return of holding the previous bar's position, of buy-and-hold, and the equity drawdown, per symbol."""
    b = bars.withColumns({"_r": ts.pct_change(c.close), "_p": ts.lag(F.col(position))})
    b = b.withColumn("_sr", F.coalesce(F.col("_p") * F.col("_r"), F.lit(0.0)))
    b = b.withColumn("_eq", ts.cum_prod1p(F.col("_sr")))
    b = b.withColumn("_dd", F.col("_eq") / F.max("_eq").over(ts.sofar()) - 1)
    return b.groupBy("symbol").agg(
        (F.max_by("_eq", "date") - 1).alias("strategy_return"),
        (F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("hold_return"),
        F.min("_dd").alias("max_drawdown"),
    )
