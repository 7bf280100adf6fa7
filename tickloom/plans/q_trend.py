"""Trend classifiers, voting strategies and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, rnd
from ..operators import consensus as con
from ..operators import indicators as ind
from ..operators import strategies as st
from ..operators import trend as tr
from ..operators.snapshot import snapshot as full_snapshot
from ..sources import bars as B
from .catalog import query
from .q_windows import _DIV
from .sqltext import BARS, MASTER, W, panel, with_
from .sqltext import rnd as rnds
from .tables import rounded, segment_bars, segment_panel, supplier_bars, supplier_panel, suppliers


def status_sql(mas: str, cap: float, tag: str = "") -> str:
    m = mas.split()
    up = " AND ".join(f"{a} > {b}" for a, b in zip(["close", *m], m))
    dn = " AND ".join(f"{a} < {b}" for a, b in zip(["close", *m], m))
    null = " OR ".join(f"{x} IS NULL" for x in m)
    return (f"CASE WHEN {null} THEN 'Insufficient History' WHEN {up} AND diff_200 BETWEEN 0.01 AND {cap} THEN 'In Bull Run{tag}' "
            f"WHEN {dn} AND diff_200 BETWEEN -{cap} AND -0.01 THEN 'In Bear Run{tag}' ELSE 'Unconfirmed' END")


D200 = "d2 AS (SELECT *, CASE WHEN sma_200 > 0 THEN (close - sma_200) * 100.0 / sma_200 END AS diff_200 FROM panel)"
A_MAS, SL_MAS = "sma_20 sma_50 sma_100 sma_200", "sma_20 sma_50 sma_100 sma_150 sma_200"


@query("c1_trend_status", panel("s", D200, body=f"""SELECT symbol, date, round(close, 4) AS close, round(sma_20, 4) AS sma_20, round(sma_50, 4) AS sma_50, round(sma_100, 4) AS sma_100,
  round(sma_200, 4) AS sma_200, round(diff_200, 4) AS diff_200, {status_sql(A_MAS, 20)} AS trend_status, round(close * volume, 2) AS traded_value FROM d2 WHERE is_last"""))
def c1(spark, d):
    p = ts.latest(ind.sma(supplier_bars(spark, d)))
    p = tr.trend_status(p).withColumn("traded_value", rnd(c.close * c.volume, 2))
    return rounded(p.select("symbol", "date", "close", "sma_20", "sma_50", "sma_100", "sma_200", "diff_200", "trend_status", "traded_value")).orderBy(F.desc("traded_value"))


@query("c2_trend_status_sl", panel("s", D200, body=f"SELECT symbol, date, {status_sql(SL_MAS, 1000, ' (SL)')} AS trend_status_sl FROM d2"))
def c2(spark, d):
    return tr.trend_status_sl(ind.sma(supplier_bars(spark, d)), cap=1000.0).select("symbol", "date", "trend_status_sl")


@query("c3_trend_status_simple", panel("s", D200, body="""SELECT symbol, date, CASE WHEN sma_200 IS NULL THEN 'Insufficient History'
  WHEN close > sma_50 AND close > sma_100 AND close > sma_200 AND diff_200 BETWEEN 0.01 AND 10 THEN 'In Bull Run'
  WHEN close < sma_50 AND close < sma_100 AND close < sma_200 AND diff_200 BETWEEN -10 AND -0.01 THEN 'In Bear Run' ELSE 'Unconfirmed' END AS trend_status_simple FROM d2"""))
def c3(spark, d):
    return tr.trend_status_simple(ind.sma(supplier_bars(spark, d))).select("symbol", "date", "trend_status_simple")


CAR = """top AS (SELECT symbol, arg_min(date, row(-high, date)) AS d0, count(*) AS n FROM bars GROUP BY symbol),
sl AS (SELECT b.symbol, b.date, b.close, t.n, avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS ca,
  row_number() OVER (PARTITION BY b.symbol ORDER BY b.date DESC) AS fe FROM bars b JOIN top t ON b.symbol = t.symbol AND b.date >= t.d0),
sl2 AS (SELECT *, lag(ca) OVER (PARTITION BY symbol ORDER BY date) AS pca FROM sl),
car AS (SELECT symbol, CASE WHEN max(n) < 10 OR count(*) < 10 THEN 'Short History' WHEN count(*) FILTER (WHERE fe <= 10 AND close > ca) >= 8 THEN 'Buy/Average Out' ELSE 'Avoid/Hold' END AS car_rating,
  CASE WHEN max(n) < 10 OR count(*) < 10 THEN 'Short History' WHEN count(*) FILTER (WHERE fe <= 9 AND ca > pca) = 9 THEN 'Buy/Average Out' ELSE 'Avoid/Hold' END AS car_rising FROM sl2 GROUP BY symbol)"""


@query("c4_car_rating", with_(BARS["s"], CAR, body="SELECT symbol, car_rating FROM car"))
def c4(spark, d):
    return tr.car_rating(supplier_bars(spark, d)).select("symbol", "car_rating")


@query("c5_car_rising", with_(BARS["s"], CAR, body="SELECT symbol, car_rising FROM car"))
def c5(spark, d):
    return tr.car_rating(supplier_bars(spark, d)).select("symbol", "car_rising")


_W20 = "(PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)"
BOTTOM = f"""bo0 AS (SELECT *, CASE WHEN count(high) OVER w = 20 THEN max(high) OVER w END AS high_20d, CASE WHEN count(low) OVER w = 20 THEN min(low) OVER w END AS low_20d FROM bars WINDOW w AS {_W20}),
bo AS (SELECT *, (close - low_20d) / low_20d * 100.0 AS bounce_pct, CASE WHEN low_20d IS NULL THEN 'Short History' WHEN low_20d <= 0 THEN 'Invalid Low'
  WHEN abs(low - low_20d) / low_20d * 100.0 > 0.5 THEN 'Do not start GTT' WHEN close <= low THEN 'Do not start GTT'
  WHEN (close - low_20d) / low_20d * 100.0 < 1.0 THEN 'Start GTT (Basic)' ELSE 'Start GTT' END AS bottom_out_status,
  CASE WHEN low_20d IS NULL OR low_20d <= 0 THEN 'Wait' WHEN abs(low - low_20d) / low_20d * 100.0 > 0.5 THEN 'Wait for best time' WHEN close <= low THEN 'No bounce — avoid'
  WHEN (close - low_20d) / low_20d * 100.0 < 1.0 THEN printf('Place GTT at %.2f | Weak bounce (%.2f%%)', round(high_20d, 2), round((close - low_20d) / low_20d * 100.0, 2))
  ELSE printf('Place GTT Buy at %.2f | Stop below %.2f | Bounce: %.2f%%', round(high_20d, 2), round(low, 2), round((close - low_20d) / low_20d * 100.0, 2)) END AS swing_advice FROM bo0)"""


@query("c6_bottom_out", with_(BARS["g"], BOTTOM, body="SELECT symbol, date, round(high_20d * 1.2, 4) AS gtt_target_20pct, round(bounce_pct, 4) AS bounce_pct, bottom_out_status, swing_advice FROM bo"))
def c6(spark, d):
    return rounded(tr.bottom_out(segment_bars(spark, d)).select("symbol", "date", "gtt_target_20pct", "bounce_pct", "bottom_out_status", "swing_advice"))


CIRCUIT = f"""ci0 AS (SELECT *, (close - pc) / pc * 100.0 AS mv FROM (SELECT *, lag(close) {W} AS pc FROM bars)),
ci AS (SELECT *, CASE WHEN close > pc AND abs(close - high) < 1e-4 AND mv >= 19.8 THEN 'UC (20%)' WHEN close > pc AND abs(close - high) < 1e-4 AND mv >= 9.8 AND mv < 15 THEN 'UC (10%)'
  WHEN close > pc AND abs(close - high) < 1e-4 AND mv >= 4.8 AND mv < 7 THEN 'UC (5%)' WHEN close < pc AND abs(close - low) < 1e-4 AND -mv >= 19.8 THEN 'LC (20%)'
  WHEN close < pc AND abs(close - low) < 1e-4 AND -mv >= 9.8 AND -mv < 15 THEN 'LC (10%)' WHEN close < pc AND abs(close - low) < 1e-4 AND -mv >= 4.8 AND -mv < 7 THEN 'LC (5%)' ELSE 'None' END AS circuit_type FROM ci0)"""


@query("c7_circuit", with_(BARS["s"], CIRCUIT, body="SELECT symbol, date, circuit_type, circuit_type <> 'None' AS circuit_locked FROM ci"))
def c7(spark, d):
    return tr.circuit(supplier_bars(spark, d)).select("symbol", "date", "circuit_type", "circuit_locked")


@query("c8_ma_slope", with_(BARS["s"], f"""m AS (SELECT symbol, row_number() {W} AS rn, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS fe, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS ma FROM bars WINDOW w AS {_W20}),
s AS (SELECT symbol, regr_slope(ma, rn) AS slope FROM m WHERE fe <= 30 GROUP BY symbol HAVING count(ma) = 30)""",
  body="""SELECT symbol, round(slope, 4) AS slope, CASE WHEN abs(slope) < 0.05 THEN 'mostly flat' ELSE (CASE WHEN abs(slope) < 0.1 THEN 'very weak' WHEN abs(slope) < 0.5 THEN 'weak' WHEN abs(slope) < 1 THEN 'moderate'
   WHEN abs(slope) < 2 THEN 'strong' ELSE 'very strong' END) || ' ' || CASE WHEN slope > 0 THEN 'upward' ELSE 'downward' END END AS trend FROM s"""))
def c8(spark, d):
    return rounded(tr.ma_slope(supplier_bars(spark, d)))


STATE = """CASE WHEN NOT coalesce(close > 0, false) THEN 'SIDEWAYS'
  WHEN sma_200 > 0 AND sma_50 > 0 THEN CASE WHEN close > sma_200 AND close > sma_50 THEN 'BULL RUN' WHEN close < sma_200 AND close > sma_50 THEN 'RECOVERY' WHEN close < sma_200 AND close < sma_50 THEN 'BEAR TERRITORY' ELSE 'SIDEWAYS' END
  WHEN sma_200 > 0 THEN CASE WHEN close > sma_200 THEN 'BULL RUN' ELSE 'BEAR TERRITORY' END
  WHEN sma_50 > 0 THEN CASE WHEN close > sma_50 THEN 'BULL RUN' ELSE 'BEAR TERRITORY' END ELSE 'SIDEWAYS' END"""


@query("c9_market_state", panel("s", body=f"SELECT symbol, date, {STATE} AS market_state FROM panel"))
def c9(spark, d):
    return tr.market_state(ind.sma(supplier_bars(spark, d), (50, 200))).select("symbol", "date", "market_state")


WEEKLY = """wk AS (SELECT symbol, CAST(date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS DATE) AS wd, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
wk2 AS (SELECT symbol, wd, CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END AS f, CASE WHEN count(*) OVER w200 = 200 THEN avg(close) OVER w200 END AS s,
  row_number() OVER (PARTITION BY symbol ORDER BY wd DESC) AS fe FROM wk WINDOW w50 AS (PARTITION BY symbol ORDER BY wd ROWS 49 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY wd ROWS 199 PRECEDING)),
weekly AS (SELECT symbol, coalesce(f > s, false) AS weekly_cross FROM wk2 WHERE fe = 1)"""


@query("c10_multi_timeframe", panel("s", D200, WEEKLY, body=f"""SELECT d2.symbol, {status_sql(A_MAS, 1000)} AS trend_status, coalesce(weekly_cross, false) AS weekly_cross,
  coalesce(weekly_cross, false) AND {status_sql(A_MAS, 1000)} = 'In Bull Run' AS mtf_confirmed FROM d2 LEFT JOIN weekly USING (symbol) WHERE is_last"""))
def c10(spark, d):
    b = supplier_bars(spark, d)
    snap = tr.trend_status(ts.latest(ind.sma(b)), cap=1000.0)
    return tr.multi_timeframe(snap, tr.weekly_cross(b)).select("symbol", "trend_status", "weekly_cross", "mtf_confirmed")


ACT = """act AS (SELECT *,
  CASE WHEN rsi_14 < 25 THEN 'Level 3 Buy' WHEN rsi_14 < 30 THEN 'Level 2 Buy' WHEN rsi_14 < 35 THEN 'Level 1 Buy' ELSE 'No Action' END AS rsi_ladder_action, close * 1.0628 AS rsi_ladder_target,
  CASE WHEN (close - low_200) / low_200 * 100.0 <= 2 THEN 'Buy on Support / Demand Level' ELSE 'Hold' END AS buy_low_action, close + 2 * atr_14 AS buy_low_target, low_200 - 0.5 * atr_14 AS buy_low_sl,
  CASE WHEN close >= prev_high_55 THEN 'Buy (55D Breakout)' ELSE 'No need to fresh start' END AS turtle_action, close + 3 * atr_14 AS turtle_target, low_20 AS turtle_sl,
  CASE WHEN adx_14 > 25 AND plus_di_14 > minus_di_14 AND rsi_14 > 60 THEN 'Explosive Buy' WHEN adx_14 > 25 AND minus_di_14 > plus_di_14 AND rsi_14 < 40 THEN 'Explosive Sell' ELSE 'Hold' END AS rdx_action,
  close + 2 * atr_14 AS rdx_target, close - 1.5 * atr_14 AS rdx_sl,
  CASE WHEN prev_close <= prev_sma_100 AND close > sma_100 AND (close - low_126) / low_126 * 100.0 >= 20 THEN 'Breakout Buy' ELSE 'Hold' END AS sma100_action, close + 3 * atr_14 AS sma100_target, sma_100 AS sma100_sl,
  CASE WHEN sma_20 > 0 THEN (close - sma_20) / sma_20 * 100.0 END AS dma20_diff, CASE WHEN sma_20 > 0 AND (close - sma_20) / sma_20 * 100.0 < -2 THEN 'Buy' ELSE 'Hold' END AS dma20_action,
  CASE WHEN close > sma_50 AND close > sma_100 AND close > sma_150 AND close < sma_200 THEN 'Super BO Buy' ELSE 'Hold' END AS super_bo_action, sma_200 AS super_bo_target, close - 2 * atr_14 AS super_bo_sl,
  CASE WHEN close > sma_200 AND sma_200 > sma_150 THEN '150 DMA Breakout | CMP > 200 DMA' ELSE 'Hold' END AS dma_rev_action, close + 2 * atr_14 AS dma_rev_target, sma_150 AS dma_rev_sl,
  CASE WHEN close > sma_200 AND close > sma_50 AND sma_50 > sma_200 THEN '50 DMA Breakout | CMP > 200 DMA' ELSE 'Hold' END AS dma_nosl_action, close * 1.0628 AS dma_nosl_target FROM panel)"""

_BARWISE = {
    "v1_rsi_ladder": ("rsi_ladder_action", "rsi_ladder_target"),
    "v2_buy_low": ("buy_low_action", "buy_low_target buy_low_sl"),
    "v3_breakout_55": ("turtle_action", "turtle_target turtle_sl"),
    "v4_adx_di_rsi": ("rdx_action", "rdx_target rdx_sl"),
    "v5_sma100_breakout": ("sma100_action", "sma100_target sma100_sl"),
    "v6_dma20_retracement": ("dma20_action", "dma20_diff"),
    "v7_recovery": ("super_bo_action", "super_bo_target super_bo_sl"),
    "v8_dma_reverse": ("dma_rev_action", "dma_rev_target dma_rev_sl"),
    "v9_dma_no_sl": ("dma_nosl_action", "dma_nosl_target"),
}
for _n, (_a, _cols) in _BARWISE.items():

    def _mk(name: str, act: str, cols: str) -> None:
        @query(name, panel("s", ACT, body=f"SELECT symbol, date, {act}, {rnds(cols)} FROM act"))
        def run(spark, d):
            return rounded(st.bar_strategies(supplier_panel(spark, d)).select("symbol", "date", act, *cols.split()))

    _mk(_n, _a, _cols)

VCP = """vp0 AS (SELECT *, coalesce(high = CASE WHEN count(high) OVER w = 5 THEN max(high) OVER w END, false) AS is_peak, count(*) OVER (PARTITION BY symbol) AS n,
   row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS fe FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
vpk AS (SELECT symbol, date, high, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS pk FROM vp0 WHERE is_peak),
vleg AS (SELECT a.symbol, a.pk, (a.high - min(v.low)) / a.high * 100.0 AS leg FROM vpk a JOIN vpk b ON a.symbol = b.symbol AND b.pk = a.pk - 1 JOIN vp0 v ON v.symbol = a.symbol AND v.date BETWEEN a.date AND b.date
   WHERE a.pk <= 4 GROUP BY a.symbol, a.pk, a.high),
vlegs AS (SELECT symbol, list(leg ORDER BY pk DESC) AS legs, bool_and(coalesce(ok, true)) AS tight, arg_min(leg, pk) AS last_leg FROM (SELECT *, leg <= 1.1 * lag(leg) OVER (PARTITION BY symbol ORDER BY pk DESC) AS ok FROM vleg) GROUP BY symbol),
vcps AS (SELECT p.symbol, p.n, p.close, p.sma_50, p.sma_200, (SELECT max(high) FROM vp0 y WHERE y.symbol = p.symbol AND y.fe <= 252) AS yh, (SELECT count(*) FROM vpk k WHERE k.symbol = p.symbol) AS peaks, legs, tight AND last_leg < 10 AS tight
   FROM vp0 p LEFT JOIN vlegs USING (symbol) WHERE p.fe = 1),
vcp AS (SELECT symbol, CASE WHEN n >= 250 AND close >= sma_50 AND close >= sma_200 AND close >= 0.75 * yh AND peaks >= 3 AND tight THEN 'VCP Tightening' ELSE 'No VCP' END AS vcp_action,
   CASE WHEN n < 250 THEN printf('Insufficient data (%d < 250)', n) WHEN sma_50 IS NULL OR sma_200 IS NULL THEN 'SMA data unavailable' WHEN close < sma_50 OR close < sma_200 THEN 'Price below SMA-50 or SMA-200 (Not in Stage 2 uptrend)'
     WHEN close < 0.75 * yh THEN printf('Price too far from 52W High (%.2f < 75%% of %.2f)', round(close, 2), round(yh, 2)) WHEN peaks < 3 THEN 'Not enough price peaks found to detect contraction'
     WHEN tight THEN 'VCP Tightening Detected: Legs(' || array_to_string(list_transform(legs, lambda x: printf('%.1f%%', round(x, 1))), ', ') || ')' ELSE 'No VCP (Legs: ' || array_to_string(list_transform(legs, lambda x: printf('%.1f%%', round(x, 1))), ', ') || ')' END AS vcp_reason FROM vcps)"""


@query("v10_vcp", panel("s", VCP, body="SELECT symbol, vcp_action, vcp_reason FROM vcp"))
def v10(spark, d):
    return st.vcp(ind.sma(supplier_bars(spark, d), (50, 200))).select("symbol", "vcp_action", "vcp_reason")


SQUEEZE = f"""sq0 AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sqm, CASE WHEN count(close) OVER w = 20 THEN stddev_samp(close) OVER w END AS sqs FROM panel WINDOW w AS {_W20}),
sq AS (SELECT *, CASE WHEN bn < 33 OR sqm IS NULL OR atr_14 IS NULL THEN 'Insufficient Data' WHEN 2 * sqs < 1.5 * atr_14 AND sqm + 2 * sqs < sqm + 1.5 * atr_14 AND sqm - 2 * sqs > sqm - 1.5 * atr_14 THEN CASE WHEN close - sqm > 0 THEN 'Squeeze Active (Bullish)' ELSE 'Squeeze Active (Bearish)' END ELSE 'No Squeeze' END AS squeeze_action,
  CASE WHEN bn >= 33 AND sqm IS NOT NULL AND atr_14 IS NOT NULL THEN close - sqm END AS squeeze_momentum FROM sq0)"""


@query("v11_squeeze", panel("g", SQUEEZE, body="SELECT symbol, date, squeeze_action, round(squeeze_momentum, 4) AS squeeze_momentum FROM sq"))
def v11(spark, d):
    return rounded(st.squeeze(ind.recursive(segment_bars(spark, d))).select("symbol", "date", "squeeze_action", "squeeze_momentum"))


SUPER = """su0 AS (SELECT symbol, bn, close, (high + low) / 2.0 AS mid, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr0, high - low AS hl FROM panel_src),
su1 AS (SELECT symbol, bn, close, mid, coalesce(CASE WHEN count(*) OVER w = 10 THEN avg(CASE WHEN bn = 0 THEN hl ELSE tr0 END) OVER w END, 0) AS a FROM su0 WINDOW w AS (PARTITION BY symbol ORDER BY bn ROWS 9 PRECEDING)),
su AS (SELECT symbol, bn, 1 AS dir, 1 AS prev_dir, mid + 3 * a AS up, mid - 3 * a AS dn FROM su1 WHERE bn = 0
  UNION ALL
  SELECT s.symbol, s.bn, CASE WHEN s.bn < 10 THEN 1 WHEN s.close > r.up THEN -1 WHEN s.close < r.dn THEN 1 ELSE r.dir END, r.dir,
   CASE WHEN s.bn >= 10 AND s.close <= r.up AND s.close >= r.dn AND r.dir = 1 THEN least(s.mid + 3 * s.a, r.up) ELSE s.mid + 3 * s.a END,
   CASE WHEN s.bn >= 10 AND s.close <= r.up AND s.close >= r.dn AND r.dir = -1 THEN greatest(s.mid - 3 * s.a, r.dn) ELSE s.mid - 3 * s.a END
  FROM su r JOIN su1 s ON s.symbol = r.symbol AND s.bn = r.bn + 1),
supert AS (SELECT symbol, CASE WHEN max(bn) + 1 >= 12 THEN arg_max(dir, bn) END AS dir, CASE WHEN max(bn) + 1 >= 12 THEN arg_max(prev_dir, bn) END AS prev_dir FROM su GROUP BY symbol),
superx AS (SELECT symbol, dir AS buy_dir, dir AS sell_dir, CASE WHEN dir IS NULL THEN 'Insufficient Data' WHEN dir = -1 AND prev_dir = 1 THEN 'Long Entry' WHEN dir = 1 AND prev_dir = -1 THEN 'Close Long' ELSE 'Hold' END AS supertrend_action FROM supert)"""
_SUPER_SRC = f"panel_src AS (SELECT *, row_number() {W} - 1 AS bn, lag(close) {W} AS prev_close FROM bars)"


@query("v12_supertrend", with_(BARS["s"], _SUPER_SRC, SUPER, body="SELECT symbol, buy_dir, sell_dir, supertrend_action FROM superx", recursive=True))
def v12(spark, d):
    return st.dual_supertrend(supplier_bars(spark, d)).select("symbol", "buy_dir", "sell_dir", "supertrend_action")


CANDLE = f"""cn0 AS (SELECT symbol, date, open, high, low, close, row_number() {W} - 1 AS n, abs(close - open) AS bd, high - low AS rg, greatest(open, close) AS hi, least(open, close) AS lo FROM bars),
cn1 AS (SELECT *, avg(bd) OVER w10 AS ab, avg(rg) OVER w10 AS ar, avg(rg) OVER w5 AS a5 FROM cn0
  WINDOW w10 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
cn2 AS (SELECT *, {", ".join(f"lag({x}, {k}) {W} AS {x}{k}" for k in (1, 2) for x in ("open", "close", "low", "hi", "lo", "bd", "ab", "a5"))} FROM cn1),
cn AS (SELECT symbol, date, coalesce(nullif(array_to_string(list_filter([
  CASE WHEN n >= 10 AND bd <= 0.1 * ar THEN 'Doji' END,
  CASE WHEN n >= 2 AND close >= open AND close1 < open1 AND close > open1 AND open < close1 THEN 'Bullish Engulfing' WHEN n >= 2 AND close < open AND close1 >= open1 AND open > close1 AND close < open1 THEN 'Bearish Engulfing' END,
  CASE WHEN n >= 11 AND bd < ab AND lo - low > bd AND high - hi < 0.1 * ar AND lo <= low1 + 0.2 * a51 THEN 'Hammer' END,
  CASE WHEN n >= 11 AND bd < ab AND high - hi > bd AND lo - low < 0.1 * ar AND lo > hi1 THEN 'Shooting Star' END,
  CASE WHEN n >= 12 AND bd2 > ab2 AND close2 < open2 AND bd1 <= ab1 AND hi1 < lo2 AND bd > ab AND close >= open AND close > close2 + 0.3 * bd2 THEN 'Morning Star' END], lambda x: x IS NOT NULL), ', '), ''), 'None') AS candle_pattern FROM cn2)"""


@query("v13_candles", with_(BARS["g"], CANDLE, body="SELECT symbol, date, candle_pattern FROM cn"))
def v13(spark, d):
    return st.candles(segment_bars(spark, d)).select("symbol", "date", "candle_pattern")


_F4 = ("rsi_14", "adx_14", "cci_14", "macd_hist")
KNN = f"""kn0 AS (SELECT *, coalesce(lead(close) {W} > close, false) AS up, count(*) OVER (PARTITION BY symbol) AS nbars FROM panel),
kn1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS fe FROM kn0 WHERE {" AND ".join(f"{f} IS NOT NULL" for f in _F4)}),
kn2 AS (SELECT symbol, fe, up, nbars, count(*) OVER p AS n, {", ".join(f"coalesce(({f} - min({f}) OVER p) / nullif(max({f}) OVER p - min({f}) OVER p, 0), 0) AS s_{f}" for f in _F4)} FROM kn1 WHERE fe < 2000 WINDOW p AS (PARTITION BY symbol)),
kn3 AS (SELECT a.symbol, a.fe, a.up, a.n, a.nbars, {" + ".join(f"abs(a.s_{f} - q.s_{f})" for f in _F4)} AS dist FROM kn2 a JOIN kn2 q ON a.symbol = q.symbol AND q.fe = 0 WHERE a.fe > 0),
kn4 AS (SELECT * FROM kn3 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dist, fe) <= 8),
knn AS (SELECT symbol, knn_up, CASE WHEN nb >= 50 AND n >= 20 AND knn_up > 0.5 THEN 'Lorentzian Buy' ELSE 'No Signal' END AS knn_action FROM (
  SELECT symbol, max(n) AS n, max(nbars) AS nb, CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN count(*) FILTER (WHERE dist = 0 AND up) / count(*) FILTER (WHERE dist = 0) ELSE sum(CASE WHEN up THEN 1.0 / dist ELSE 0 END) / sum(1.0 / dist) END AS knn_up FROM kn4 GROUP BY symbol))"""


@query("v14_knn_direction", panel("s", KNN, body="SELECT symbol, round(knn_up, 4) AS knn_up, knn_action FROM knn"))
def v14(spark, d):
    p = ind.cci(ind.recursive(supplier_bars(spark, d)))
    return rounded(st.knn_direction(p).select("symbol", "knn_up", "knn_action"))


def snapshot(spark, d, kind=supplier_bars):
    """Latest-bar snapshot; the cap on the distance from the 200-bar mean is widened for this data."""
    return full_snapshot(kind(spark, d), cap=1000.0)


SNAP_CTES = (D200, ACT, CAR, BOTTOM, CIRCUIT, VCP, SQUEEZE, "panel_src AS (SELECT * FROM panel)", SUPER, CANDLE, KNN, _DIV)


def _snap_cte() -> str:
    from .q_windows import RATING, SCORE

    return f"""snap0 AS (SELECT a.*, d2.diff_200, {status_sql(A_MAS, 1000).replace('diff_200', 'd2.diff_200').replace('close', 'a.close').replace('sma_', 'a.sma_')} AS trend_status,
  {status_sql(SL_MAS, 1000, ' (SL)').replace('diff_200', 'd2.diff_200').replace('close', 'a.close').replace('sma_', 'a.sma_')} AS trend_status_sl FROM act a JOIN d2 USING (symbol, date) WHERE a.is_last),
snap1 AS (SELECT s.*, car_rating, car_rising, bo.high_20d, bo.low_20d, bo.high_20d AS gtt_trigger, bo.high_20d * 1.2 AS gtt_target_20pct, bottom_out_status, swing_advice, circuit_type, vcp_action, vcp_reason, squeeze_action, supertrend_action, candle_pattern,
  coalesce(knn_action, 'No Signal') AS knn_action, rsi_divergence, macd_divergence, s.close * s.volume AS traded_value
  FROM snap0 s JOIN car USING (symbol) JOIN bo ON bo.symbol = s.symbol AND bo.date = s.date JOIN ci ON ci.symbol = s.symbol AND ci.date = s.date LEFT JOIN vcp ON vcp.symbol = s.symbol JOIN sq ON sq.symbol = s.symbol AND sq.date = s.date
  LEFT JOIN superx ON superx.symbol = s.symbol JOIN cn ON cn.symbol = s.symbol AND cn.date = s.date LEFT JOIN knn ON knn.symbol = s.symbol LEFT JOIN divergences dv ON dv.symbol = s.symbol),
snap2 AS (SELECT *, {SCORE} AS tech_score, {STATE} AS market_state FROM snap1),
snap AS (SELECT *, {RATING} AS tech_rating FROM snap2)"""


def snap_sql(*more: str, body: str, kind: str = "s") -> str:
    return panel(kind, *SNAP_CTES, _snap_cte(), *more, body=body)


def in_list(labels) -> str:
    return "(" + ", ".join("'" + x + "'" for x in labels) + ")"


def _weights_sql(labels, weight: bool) -> str:
    return " + ".join(f"CASE WHEN {v}_action IN {in_list(labels)} THEN {con.WEIGHTS[v] if weight else 1} ELSE 0 END" for v in st.VOTERS)


VOTES = f"votes AS (SELECT *, ({_weights_sql(con.BUY_LABELS, False)}) - ({_weights_sql(con.SELL_LABELS, False)}) AS consensus_score FROM snap)"


@query("v15_consensus_vote", snap_sql(VOTES, body="""SELECT symbol, consensus_score, CASE WHEN consensus_score >= 4 THEN '⭐ ' || consensus_score || '/13 strategies agree: HIGH CONVICTION BUY on ' || symbol
  WHEN consensus_score > 0 THEN '⚖️ ' || consensus_score || '/13 strategies agree: BUY recommendation on ' || symbol WHEN consensus_score <= -4 THEN '⚠️ ' || -consensus_score || '/13 strategies agree: HIGH CONVICTION SELL on ' || symbol
  WHEN consensus_score < 0 THEN '⚠️ ' || -consensus_score || '/13 strategies agree: SELL recommendation on ' || symbol ELSE '⚖️ Neutral consensus on ' || symbol END AS consensus_callout FROM votes"""))
def v15(spark, d):
    return con.vote(snapshot(spark, d)).select("symbol", "consensus_score", "consensus_callout")


_TW = sum(con.WEIGHTS.values())


@query("v16_weighted_score", snap_sql(f"""wt AS (SELECT symbol, ({_weights_sql(con.BUY_LABELS, True)}) / {_TW} * 10.0 AS bull, ({_weights_sql(con.SELL_LABELS, True)}) / {_TW} * 10.0 AS bear FROM snap)""",
  body="""SELECT symbol, round(CAST(bull AS DOUBLE), 2) AS bull_score, round(CAST(bear AS DOUBLE), 2) AS bear_score, CASE WHEN bull - bear >= 3.5 THEN 'STRONG BUY' WHEN bull - bear >= 1 THEN 'HOLD / ADD ON DIPS' WHEN bull - bear <= -3.5 THEN 'EXIT / REDUCE'
   WHEN bull - bear <= -1 THEN 'REDUCE / MONITOR' ELSE 'NEUTRAL / SIDEWAYS' END AS portfolio_action, round(CAST(CASE WHEN abs(bull - bear) >= 3.5 THEN least(100.0, 50 + abs(bull - bear) * 8) WHEN abs(bull - bear) >= 1 THEN 50 + abs(bull - bear) * 8 ELSE 50 END AS DOUBLE), 1) AS confidence_pct FROM wt"""))
def v16(spark, d):
    return con.weighted(snapshot(spark, d)).select("symbol", "bull_score", "bear_score", "portfolio_action", "confidence_pct")


def _named_sql(labels) -> str:
    return ", ".join(f"CASE WHEN {v}_action IN {in_list(labels)} THEN '{con.VOTER_NAMES[v]} (' || {v}_action || ')' END" for v in st.VOTERS)


def _div_sql(k: str) -> str:
    return ", ".join(f"CASE WHEN {x}_divergence = '{k}' THEN '{x.upper()} {k} Divergence ({k})' END" for x in ("rsi", "macd"))


@query("v17_vote_explanation", snap_sql(body=f"""SELECT symbol, array_to_string(list_slice(list_filter([{_named_sql(con.BUY_LABELS)}, {_div_sql('Bullish')}, CASE WHEN candle_pattern NOT IN ('None', 'N/A', '') THEN 'Candlestick: ' || candle_pattern END], lambda x: x IS NOT NULL), 1, 4), '; ') AS drivers,
  array_to_string(list_slice(list_filter([{_named_sql(con.CAUTION_LABELS)}, {_div_sql('Bearish')}], lambda x: x IS NOT NULL), 1, 3), '; ') AS cautions FROM snap"""))
def v17(spark, d):
    return con.explain(snapshot(spark, d)).select("symbol", "drivers", "cautions")
