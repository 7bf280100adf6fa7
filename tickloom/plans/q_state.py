"""Indicators carried forward: a stored state and the newest days only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental as inc
from ..session import written
from ..sources import bars as B
from .catalog import query
from .sqltext import BARS, panel, with_
from .sqltext import rnd as rnds
from .tables import _bars, rounded, table

_COLUMNS = (
    "sma_20 sma_50 sma_100 sma_150 sma_200 ema_20 ema_50 ema_100 ema_200 rsi_14 macd macd_signal macd_hist bb_upper bb_lower atr_14 plus_di_14 minus_di_14 adx_14 cci_14 "
    "low_20 low_126 low_200 high_55 high_252 low_252 z_score vol_spike change_pct prev_high_55 prev_sma_100"
)


def _until(spark, d: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Trades up to ``days`` days before the newest one, and the trades after that."""
    lines = table(spark, d, "lineitem")
    cut = lines.agg(F.max("l_shipdate") - F.expr(f"INTERVAL {days} DAYS")).scalar()
    sym = F.col("l_suppkey").cast("string")
    return _bars(lines.where(F.col("l_shipdate") <= cut), sym), _bars(lines.where(F.col("l_shipdate") > cut), sym)


def _carried(spark, d: str, days: int) -> DataFrame:
    """The last indicator row of every symbol: stored state of the history, updated with the new days."""
    history, new = _until(spark, d, days)
    state = written(inc.build_state(history))
    return rounded(inc.panel_row(inc.update_state(state, new)).select("symbol", "date", "bn", *_COLUMNS.split()))


_LAST = f"SELECT symbol, date, CAST(bn AS INTEGER) AS bn, {rnds(_COLUMNS)} FROM panel WHERE is_last"


@query("w11_state_one_day", panel("s", body=_LAST))
def w11_state(spark, d):
    """State up to the day before the newest one, plus that day."""
    return _carried(spark, d, 1)


@query("q12_state_catch_up", panel("s", body=_LAST))
def q12_state(spark, d):
    """State up to 120 days before the newest one, plus all days since: a batch folded bar by bar."""
    return _carried(spark, d, 120)


@query("q10_late_bars", with_(BARS["s"], body="""SELECT b.symbol, b.date, round(b.close, 4) AS close, l.date AS state_date FROM bars b
  JOIN (SELECT symbol, max(date) AS date FROM bars GROUP BY symbol) l USING (symbol) WHERE b.date > (SELECT max(date) - INTERVAL 30 DAYS FROM bars)"""))
def q10_late(spark, d):
    """A batch that is sent again: every bar of it is late for the state that has it already."""
    history, _ = _until(spark, d, 0)
    _, again = _until(spark, d, 30)
    state = written(inc.build_state(history))
    return rounded(inc.late_bars(state, again).select("symbol", "date", "close", "state_date"))
