"""Signal union, consensus votes, weighted scores and their explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import bands, c, rnd
from .strategies import VOTERS

# fixed values: labels that count as a buy or a sell vote, and the weight of each voter
BUY_LABELS = [
    "Buy", "Breakout Buy", "Explosive Buy", "Level 1 Buy", "Level 2 Buy", "Level 3 Buy",
    "150 DMA Breakout | CMP > 200 DMA", "50 DMA Breakout | CMP > 200 DMA", "Super BO Buy",
    "Buy on Support / Demand Level", "Buy (55D Breakout)", "VCP Tightening",
    "Squeeze Active (Bullish)", "Long Entry", "Lorentzian Buy",
]
SELL_LABELS = ["Explosive Sell", "Lorentzian Sell"]
CAUTION_LABELS = [*SELL_LABELS, "Squeeze Active (Bearish)", "Close Long"]
WEIGHTS = {
    "rsi_ladder": 1.0, "buy_low": 1.0, "turtle": 2.0, "rdx": 2.0, "sma100": 1.0, "dma20": 1.0, "super_bo": 1.5,
    "dma_rev": 1.5, "dma_nosl": 1.5, "vcp": 2.0, "squeeze": 2.0, "supertrend": 1.5, "knn": 2.0,
}


def _sum(cols: list[Column]) -> Column:
    total = cols[0]
    for x in cols[1:]:
        total = total + x
    return total


def _weight_of(labels: list[str], weight: bool) -> Column:
    one = lambda v: F.lit(WEIGHTS[v] if weight else 1)
    zero = 0.0 if weight else 0
    return _sum([F.when(F.col(f"{v}_action").isin(labels), one(v)).otherwise(zero) for v in VOTERS])


def vote(snapshot: DataFrame) -> DataFrame:
    """Consensus score (buys minus sells over the 13 voters) and its call-out text."""
    s = snapshot.withColumn("consensus_score", _weight_of(BUY_LABELS, False) - _weight_of(SELL_LABELS, False))
    n, k = len(VOTERS), F.abs(c.consensus_score)
    say = lambda icon, what: F.concat(F.lit(icon), k.cast("string"), F.lit(f"/{n} strategies agree: {what} on "), c.symbol)
    text = (
        F.when(c.consensus_score >= 4, say("⭐ ", "HIGH CONVICTION BUY"))
        .when(c.consensus_score > 0, say("⚖️ ", "BUY recommendation"))
        .when(c.consensus_score <= -4, say("⚠️ ", "HIGH CONVICTION SELL"))
        .when(c.consensus_score < 0, say("⚠️ ", "SELL recommendation"))
        .otherwise(F.concat(F.lit("⚖️ Neutral consensus on "), c.symbol))
    )
    return s.withColumn("consensus_callout", text)


def weighted(snapshot: DataFrame) -> DataFrame:
    """Weighted bull/bear score (0-10), portfolio action and confidence."""
    total = sum(WEIGHTS.values())
    s = snapshot.withColumns(
        {"_bull": _weight_of(BUY_LABELS, True) / total * 10.0, "_bear": _weight_of(SELL_LABELS, True) / total * 10.0}
    ).withColumn("_net", F.col("_bull") - F.col("_bear"))
    net = F.col("_net")
    raw = 50.0 + F.abs(net) * 8.0
    return s.withColumns(
        {
            "bull_score": rnd("_bull", 2),
            "bear_score": rnd("_bear", 2),
            "portfolio_action": F.when(net >= 3.5, "STRONG BUY").when(net >= 1.0, "HOLD / ADD ON DIPS")
            .when(net <= -3.5, "EXIT / REDUCE").when(net <= -1.0, "REDUCE / MONITOR").otherwise("NEUTRAL / SIDEWAYS"),
            "confidence_pct": rnd(F.when(F.abs(net) >= 3.5, F.least(F.lit(100.0), raw)).when(F.abs(net) >= 1.0, raw).otherwise(50.0), 1),
        }
    ).drop("_bull", "_bear", "_net")


# fixed values: display name of each voter in the explanation
VOTER_NAMES = {
    "rsi_ladder": "Nifty Shop", "buy_low": "Buy Low Sell High", "turtle": "Turtle (55D Breakout)", "rdx": "RDX Momentum",
    "sma100": "100 SMA Breakout", "dma20": "ETF Shop", "super_bo": "Super BO Breakout", "dma_rev": "DMA Reverse",
    "dma_nosl": "DMA No-SL", "vcp": "Volatility Contraction Pattern (VCP)", "squeeze": "TTM Squeeze",
    "supertrend": "Dual Supertrend", "knn": "Lorentzian ML Classification",
}


def explain(snapshot: DataFrame, max_drivers: int = 4, max_cautions: int = 3) -> DataFrame:
    """Driver and caution lists of a row: voters first, then divergences, then the candle pattern."""

    def named(labels: list[str]) -> list[Column]:
        out = []
        for v in VOTERS:
            a = F.col(f"{v}_action")
            out.append(F.when(a.isin(labels), F.concat(F.lit(VOTER_NAMES[v] + " ("), a, F.lit(")"))))
        return out

    def div(kind: str) -> list[Column]:
        return [
            F.when(F.col(f"{x}_divergence") == kind, F.lit(f"{x.upper()} {kind} Divergence ({kind})")) for x in ("rsi", "macd")
        ]

    candle = F.when(~c.candle_pattern.isin("None", "N/A", ""), F.concat(F.lit("Candlestick: "), c.candle_pattern))
    pick = lambda items, n: F.slice(F.filter(F.array(*items), lambda x: x.isNotNull()), 1, n)
    return snapshot.withColumns(
        {
            "drivers": F.concat_ws("; ", pick([*named(BUY_LABELS), *div("Bullish"), candle], max_drivers)),
            "cautions": F.concat_ws("; ", pick([*named(CAUTION_LABELS), *div("Bearish")], max_cautions)),
        }
    )


def unpivot_actions(snapshot: DataFrame, voters: list[str] = VOTERS, keep: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per (row, strategy) with its action."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("strategy"), F.col(f"{v}_action").alias("action")) for v in voters]))
    return snapshot.select(*keep, pairs.alias("_p")).select(*keep, "_p.strategy", "_p.action")


def signal(df: DataFrame, strategy: str, action: Column, conviction: Column, when: Column, meta: dict[str, Column]) -> DataFrame:
    """Shape rows as signals: symbol, strategy_name, action, conviction, timestamp, meta (map of strings)."""
    kv = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        "symbol", F.lit(strategy).alias("strategy_name"), action.cast("int").alias("action"),
        conviction.cast("double").alias("conviction"), when.alias("timestamp"), F.create_map(*kv).alias("meta"),
    )


def consensus_mean(signals: DataFrame) -> DataFrame:
    """Average of action * conviction per symbol (map-side partial averages)."""
    return signals.groupBy("symbol").agg(F.avg(F.col("action") * F.col("conviction")).alias("score"))


def recommendation(score: Column) -> Column:
    buy = bands(score, [(0.3, "STRONG_BUY"), (0.1, "BUY")], None, op=">")
    sell = bands(score, [(-0.3, "STRONG_SELL"), (-0.1, "SELL")], None, op="<")
    return F.coalesce(buy, sell, F.lit("HOLD"))


def flatten_meta(signals: DataFrame, keys: list[str]) -> DataFrame:
    """meta map entries as ``meta_<key>`` columns."""
    return signals.select("*", *[F.col("meta")[k].alias(f"meta_{k}") for k in keys]).drop("meta")
