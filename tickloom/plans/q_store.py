"""Queries on bars that are stored once: by symbol in sorted buckets, by day in months."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ts
from ..operators import indicators as ind
from ..operators import risk, trend
from ..sources import barstore
from .catalog import query
from .q_risk import _RISK
from .q_state import _until
from .q_trend import D200, status_sql
from .sqltext import BARS, panel, with_
from .tables import rounded, supplier_bars

_BUCKETS = 16


def _store(spark, d):
    return barstore.store_bars(supplier_bars(spark, d), _BUCKETS)


@query("s3_store_range", with_(BARS["s"], body="SELECT symbol, date, round(close, 4) AS close, round(volume, 4) AS volume FROM bars WHERE date BETWEEN DATE '1998-03-10' AND DATE '1998-05-20'"))
def s3_store(spark, d):
    """A date range: three months of the store are read."""
    return rounded(_store(spark, d).by_day("1998-03-10", "1998-05-20").select("symbol", "date", "close", "volume"))


@query("c1_store_trend", panel("s", D200, body=f"SELECT symbol, date, round(sma_200, 4) AS sma_200, {status_sql('sma_20 sma_50 sma_100 sma_200', 20)} AS trend_status FROM d2 WHERE is_last"))
def c1_store(spark, d):
    """Trend status from the buckets: no exchange, no sort."""
    p = trend.trend_status(ts.latest(ind.sma(_store(spark, d).by_symbol())))
    return rounded(p.select("symbol", "date", "sma_200", "trend_status"))


@query("q10_store_append", panel("s", body="SELECT symbol, date, round(close, 4) AS close, round(sma_20, 4) AS sma_20, round(sma_200, 4) AS sma_200 FROM panel"))
def q10_store(spark, d):
    """A store of all but the last 60 days, then those days and 30 days that it has already."""
    history, _ = _until(spark, d, 60)
    _, new = _until(spark, d, 90)
    store = barstore.store_bars(history, _BUCKETS).append(new)
    return rounded(ind.sma(store.by_symbol()).select("symbol", "date", "close", "sma_20", "sma_200"))


@query("j3_store_days", with_(BARS["s"], body="SELECT date, count(*) AS symbols, round(sum(turnover), 2) AS turnover FROM bars WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 45 DAYS GROUP BY date"))
def j3_store(spark, d):
    """Turnover by day over the last months of an appended store, from its month folders."""
    history, _ = _until(spark, d, 20)
    _, new = _until(spark, d, 20)
    store = barstore.store_bars(history, _BUCKETS).append(new)
    last = store.by_day().agg(F.max("date")).first()[0]
    first = last.fromordinal(last.toordinal() - 45)
    return rounded(store.by_day(first.isoformat()).groupBy("date").agg(F.count(F.lit(1)).alias("symbols"), F.sum("turnover").alias("turnover")), 2)


@query("r1_store_drawdown", with_(BARS["s"], _RISK, body="SELECT symbol, round(max_drawdown_pct, 4) AS max_drawdown_pct, round(sharpe_1y, 4) AS sharpe_1y FROM risk"))
def r1_store(spark, d):
    """Risk table from the buckets: no exchange, no sort."""
    return rounded(risk.risk_table(_store(spark, d).by_symbol()).select("symbol", "max_drawdown_pct", "sharpe_1y"))
