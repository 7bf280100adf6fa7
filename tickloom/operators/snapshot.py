"""One row per symbol with every indicator, classifier and strategy of its latest bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import c, evaluated
from . import indicators as ind
from . import strategies as st
from . import trend as tr


def snapshot(bars: DataFrame, cap: float = 20.0) -> DataFrame:
    """Snapshot of all symbols in one shuffle.

    Every window runs on the (symbol, date) order, the recursive indicators on its
    block-refined form, and a single ``groupBy("symbol")`` on the same partitioning
    takes the latest row together with all per-symbol aggregates.  What only the last
    bar needs (means, bands, extremes, candles, exponential averages) is an aggregate
    over bars by age, so that no bar carries window columns through the later windows.
    Bar-wise labels are computed on the one remaining row per symbol.
    """
    p = ind.latest_columns(bars.withColumn("_up", st.went_up()))
    p = st.supertrend_columns(st.vcp_columns(tr.car_columns(p)))
    p = st.knn_columns(ind.recursive(p, ema=()))
    aggs = {**tr.car_aggs(), **st.vcp_aggs(), **st.supertrend_aggs(), **st.knn_aggs(), **ind.divergence_aggs()}
    aggs |= {**ind.latest_aggs(), **st.candle_aggs()}
    latest = ["_r", *[x for x in p.columns if not x.startswith("_") and x not in ("symbol", "n_bars")]]
    s = p.groupBy("symbol").agg(ind.last_row(latest).alias("_last"), *[v.alias(k) for k, v in aggs.items()])
    s = st.candle_latest(ind.latest_finish(s.select("symbol", "_last.*", *aggs)))
    s = st.knn_labels(ind.divergence_labels(st.vcp_labels(tr.car_labels(s))))
    s = st.supertrend_labels(s.withColumn("_d", st.supertrend_fold(F.col("_st"))), "_d", "_d").drop("_st", "_d")
    s = evaluated(s)
    s = st.squeeze_columns(s, c.sma_20, c.std_20, c.atr_14)
    s = tr.bottom_out_columns(s.withColumns({"high_20d": c.high_20, "low_20d": c.low_20}))
    s = tr.market_state(tr.trend_status_sl(tr.trend_status(tr.circuit(s), cap), cap))
    s = ind.tech_score(st.bar_strategies(s))
    return evaluated(s.withColumn("traded_value", c.close * c.volume).drop("bn", "high_20", "car_avg", "car_prev"))


def with_universe(universe: DataFrame, snap: DataFrame, counts: DataFrame) -> DataFrame:
    """Universe left join to the snapshot; symbols without history, or with fewer than two bars, get placeholder labels."""
    u = universe.join(counts, "symbol", "left").join(snap, "symbol", "left")
    missing, short = c.n_bars.isNull(), c.n_bars < 2
    state = F.when(missing, "MISSING_PARQUET").when(short, "INSUFFICIENT_HISTORY").otherwise("PRESENT")
    gone = missing | short
    labels = {x: F.when(gone, "TICKER NOT FOUND").otherwise(F.col(x)) for x in ("trend_status", "car_rating", "bottom_out_status")}
    numbers = {x: F.when(~gone, F.col(x)) for x in ("close", "prev_close", "sma_50", "sma_200")}
    return u.withColumns({**labels, **numbers, "dq_status": state})
