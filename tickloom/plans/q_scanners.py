"""Scanners, anomalies and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, rnd, truth
from ..operators import anomaly, cointegration, forests, learn, registry
from ..operators import indicators as ind
from ..operators import consensus as con
from ..operators import portfolio as pf
from ..operators import quality as q
from ..operators import scanners as sn
from ..session import written
from .catalog import query
from .q_quality import _OUT
from .sqltext import BARS, MASTER, SOFAR, W, full, panel, with_
from .tables import index_close, nation_bars, rounded, segment_bars, supplier_bars, suppliers

_HINT = "CASE WHEN rsi_14 < 5 THEN 'Step 7 (Average < 5)' WHEN rsi_14 < 10 THEN 'Step 6 (Average < 10)' WHEN rsi_14 < 15 THEN 'Step 5 (Average < 15)' WHEN rsi_14 < 20 THEN 'Step 4 (Average < 20)' WHEN rsi_14 < 25 THEN 'Step 3 (Average < 25)' WHEN rsi_14 < 30 THEN 'Step 2 (Average < 30)' ELSE 'Step 1 (Entry < 35)' END"
# the entry level is widened so that the latest bars give candidates
_RSI = f"scan AS (SELECT p.symbol, round(rsi_14, 4) AS rsi_14, round(prev_close - 0.01, 2) AS amo_price, {_HINT} AS step_hint, coalesce(acctbal > 5000, false) AS in_index, round(least(1.0, greatest(0.0, (50 - rsi_14) / 25.0)), 2) AS conviction FROM panel p JOIN master m ON m.symbol = p.symbol WHERE is_last AND rsi_14 < 50 AND sector <> 'ASIA')"


def _rsi(spark, d):
    m = suppliers(spark, d)
    b = supplier_bars(spark, d).withColumn("prev_close", ts.lag(c.close))
    s = ts.latest(ind.recursive(b))
    return sn.rsi_scan(s, m.filter(c.sector != "ASIA"), m.filter(c.acctbal > 5000), entry=50.0)


@query("x1_rsi_scan", panel("s", MASTER, _RSI, body="SELECT * FROM scan"))
def x1(spark, d):
    return _rsi(spark, d).select("symbol", rnd("rsi_14").alias("rsi_14"), "amo_price", "step_hint", "in_index", "conviction")


@query("x2_best_pick", panel("s", MASTER, _RSI, body="SELECT symbol, rsi_14, amo_price, step_hint FROM scan ORDER BY rsi_14, symbol LIMIT 1"))
def x2(spark, d):
    return rounded(sn.best_pick(_rsi(spark, d)))


@query("x3_averaging", panel("s", "h AS (SELECT symbol, date, lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) AS lbp, 1 + CAST(bn % 7 AS INTEGER) AS ls, close, rsi_14, is_last FROM panel)",
  body="""SELECT symbol, ls AS last_step, round(coalesce((lbp - close) / lbp * 100, 0), 4) AS price_drop_pct, coalesce(ls < 7 AND rsi_14 < CASE ls WHEN 1 THEN 30 WHEN 2 THEN 25 WHEN 3 THEN 20 WHEN 4 THEN 15 WHEN 5 THEN 10 ELSE 5 END AND (lbp - close) / lbp * 100 >= 3.14, false) AS eligible FROM h WHERE is_last"""))
def x3(spark, d):
    b = ts.position(supplier_bars(spark, d))
    h = ts.latest(b.select("symbol", "date", ts.lag(c.close, 20).alias("last_buy_price"), (c.bn % 7 + 1).cast("int").alias("last_step")))
    s = ts.latest(ind.recursive(b))
    return rounded(sn.averaging(h.drop("date"), s).select("symbol", "last_step", "price_drop_pct", "eligible"))


_DARVAS = f"""dv0 AS (SELECT *, row_number() {W} AS rn, {full('max', 'high', 20)} AS hi, {full('min', 'low', 10)} AS box_low, {full('avg', 'volume', 20)} AS va FROM bars),
dv1 AS (SELECT *, lag(hi) {W} AS box_high FROM dv0), dv2 AS (SELECT *, rn - coalesce(max(CASE WHEN NOT coalesce(high <= box_high, false) THEN rn END) {SOFAR}, 0) AS td FROM dv1),
dv3 AS (SELECT *, coalesce(lag(td) {W}, 0) AS yd, coalesce(va > 0 AND volume >= 1.5 * va, false) AS vc FROM dv2),
dv AS (SELECT *, CASE WHEN rn < 25 THEN 'Insufficient Data' WHEN yd >= 5 AND close > box_high AND vc THEN 'Breakout (Volume Confirmed)' WHEN yd >= 5 AND close < box_low AND vc THEN 'Breakdown (Volume Confirmed)'
  WHEN yd >= 5 AND close > box_high THEN 'Breakout (No Volume Confirmation)' WHEN td >= 5 THEN printf('Consolidating (%d days)', td) ELSE 'No Pattern' END AS darvas_signal FROM dv3)"""


@query("x4_darvas", with_(BARS["g"], _DARVAS, body="SELECT symbol, date, darvas_signal, vc AND rn >= 25 AS vol_confirmed, CAST(CASE WHEN rn < 25 THEN 0 WHEN darvas_signal LIKE 'Break%' THEN yd ELSE td END AS INTEGER) AS box_days FROM dv"))
def x4(spark, d):
    return sn.darvas(segment_bars(spark, d)).select("symbol", "date", "darvas_signal", "vol_confirmed", "box_days")


_MSQ = f"""m0 AS (SELECT *, row_number() {W} AS rn, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM bars),
m1 AS (SELECT *, {full('avg', 'close', 20)} AS m, {full('stddev_samp', 'close', 20)} AS sd, {full('avg', 'tr', 20)} AS a, {full('max', 'high', 20)} AS hh, {full('min', 'low', 20)} AS ll FROM m0),
m2 AS (SELECT *, close - ((hh + ll) / 2 + m) / 2 AS src FROM m1),
m3 AS (SELECT *, CASE WHEN count(src) OVER w = 20 THEN regr_intercept(src, rn) OVER w + regr_slope(src, rn) OVER w * rn END AS v FROM m2 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
ms AS (SELECT *, coalesce(1.5 * sd < 1.5 * a AND m - 1.5 * sd > m - 1.5 * a, false) AS son, coalesce(m - 1.5 * sd < m - 1.5 * a AND m + 1.5 * sd > m + 1.5 * a, false) AS soff,
  CASE WHEN v > 0 THEN CASE WHEN v > coalesce(lag(v) {W}, 0) THEN 'lime' ELSE 'green' END WHEN v < coalesce(lag(v) {W}, 0) THEN 'red' ELSE 'maroon' END AS hist_color FROM m3)"""


@query("x5_momentum_squeeze", with_(BARS["g"], _MSQ, body="SELECT symbol, date, round(v, 4) AS momentum, son AS squeeze_on, soff AS squeeze_off, hist_color FROM ms WHERE v IS NOT NULL"))
def x5(spark, d):
    return rounded(sn.momentum_squeeze(segment_bars(spark, d)).select("symbol", "date", "momentum", "squeeze_on", "squeeze_off", "hist_color"))


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) {W}"


_LEAD = f"""l0 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, lead(date) {W} IS NULL AS is_last, {", ".join(f"{full('avg', 'close', k)} AS m{k}" for k in (50, 150, 200))}, {full('max', 'high', 252)} AS hi, {full('min', 'low', 252)} AS lo,
  {full('avg', 'volume', 50)} AS vm, {full('max', 'high', 60)} AS base, CASE WHEN close < lag(close) {W} THEN volume END AS dv, abs(close / lag(close) {W} - 1) AS ar,
  0.4 * (close / {_lag('close', 252)} - 1) + 0.2 * (close / {_lag('close', 126)} - 1) + 0.2 * (close / {_lag('close', 63)} - 1) + 0.2 * (close / {_lag('close', 21)} - 1) AS rs FROM bars),
l1 AS (SELECT *, {_lag('m200', 30)} AS p200, {_lag('m50', 9)} AS p50, {full('max', 'dv', 10)} AS mdv, {full('avg', 'ar', 20)} AS v20 FROM l0),
l2 AS (SELECT *, {_lag('v20', 39)} AS pv20 FROM l1),
ld AS (SELECT symbol, round(rs, 8) AS rs, CAST(close > m50 AS INTEGER) + CAST(close > m150 AS INTEGER) + CAST(close > m200 AS INTEGER) + CAST(m50 > m150 AS INTEGER) + CAST(m50 > m200 AS INTEGER) + CAST(m150 > m200 AS INTEGER)
  + CAST(close >= lo * 1.3 AS INTEGER) + CAST(close >= hi * 0.75 AS INTEGER) + CAST(m200 > p200 AS INTEGER) AS template_score, volume / vm AS rvol, close / hi AS high_proximity, coalesce(close > m150 AND m150 > m200 AND m50 > p50, false) AS stage2,
  base, coalesce(close > base, false) AS breakout, coalesce(volume > mdv, false) AS pocket_pivot, coalesce(v20 < pv20, false) AS contraction FROM l2 WHERE is_last AND n >= 256),
lr AS (SELECT *, (rank() OVER (ORDER BY rs) + (count(*) OVER (PARTITION BY rs) - 1) / 2.0) / count(*) OVER () * 100 AS rs_rating FROM ld)"""


def _lead(name, cols, sqlcols=None):
    @query(name, with_(BARS["s"], _LEAD, body=f"SELECT symbol, {sqlcols} FROM lr"))
    def run(spark, d):
        return rounded(sn.leader_table(supplier_bars(spark, d)).select("symbol", *cols))


_lead("x6_rs_rating", ["rs_rating"], "round(rs_rating, 4) AS rs_rating")
_lead("x7_trend_template", ["template_score"], "template_score")
_lead("x8_rvol_proximity", ["rvol", "high_proximity"], "round(rvol, 4) AS rvol, round(high_proximity, 4) AS high_proximity")
_lead("x9_stage2", ["stage2"], "stage2")
_lead("x10_pivots", ["pivot", "breakout", "pocket_pivot", "contraction"], 'round(base, 4) AS "pivot", breakout, pocket_pivot, contraction')


@query("x11_candidates", with_(BARS["s"], _LEAD, body="SELECT symbol, round(rs_rating, 4) AS rs_rating, round(least(1.0, greatest(0.0, (rs_rating - 70) / 30.0)), 2) AS conviction FROM lr WHERE rs_rating >= 30 AND template_score >= 3 AND high_proximity >= 0.05 AND rvol >= 0.2 AND stage2"))
def x11(spark, d):
    t = sn.leader_candidates(sn.leader_table(supplier_bars(spark, d)), 30.0, 3, 0.05, 0.2)
    return t.select("symbol", rnd("rs_rating").alias("rs_rating"), "conviction")


LOOKBACK = 100  # common bars of a pair: two suppliers trade on 113 common days in the mean


@query("x12_cointegrated_pairs")
def x12(spark, d):
    """Every pair of suppliers with LOOKBACK common bars."""
    return rounded(cointegration.cointegrated_pairs(supplier_bars(spark, d), max_p=0.05, lookback=LOOKBACK))


@query("x12_pair_signals")
def x12_signals(spark, d):
    """Two opposite signals for each actionable pair of suppliers, without the map column."""
    pairs = cointegration.cointegrated_pairs(supplier_bars(spark, d), max_p=0.05, z_entry=2.0, lookback=LOOKBACK, neutral=False)
    t = cointegration.pair_signals(pairs, F.lit(None).cast("date"), z_entry=2.0)
    return rounded(con.flatten_meta(t, ["pair_id", "pair_symbol", "trade"]))


_PAIRS = f"""cp AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.close AS x, b.close AS y, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.date DESC) AS fe, count(*) OVER (PARTITION BY a.symbol, b.symbol) AS n
  FROM bars a JOIN bars b ON a.date = b.date AND a.symbol < b.symbol),
cs AS (SELECT symbol_a, symbol_b, regr_slope(x, y) AS slope, regr_intercept(x, y) AS intercept, sqrt((regr_syy(x, y) - regr_slope(x, y) * regr_sxy(x, y)) / {LOOKBACK - 2}) AS residual_sd,
  (arg_max(x - y, -fe) - avg(x - y) FILTER (fe <= 60)) / nullif(stddev_samp(x - y) FILTER (fe <= 60), 0) AS z_score FROM cp WHERE n >= {LOOKBACK} AND fe <= {LOOKBACK} GROUP BY symbol_a, symbol_b)"""


@query("x12_pair_spreads", with_(BARS["s"], _PAIRS, body="SELECT symbol_a, symbol_b, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(residual_sd, 4) AS residual_sd, round(z_score, 4) AS z_score FROM cs WHERE abs(z_score) >= 2"))
def x12_spreads(spark, d):
    """Regression and spread of every pair of suppliers that is two deviations apart, whatever its test says."""
    t = cointegration.tested_pairs(supplier_bars(spark, d), max_p=None, lookback=LOOKBACK, min_z=2.0)
    return rounded(t.select("symbol_a", "symbol_b", "slope", "intercept", "residual_sd", "z_score"))


_ROT = f"""bench AS (SELECT date, avg(close) AS bench FROM bars GROUP BY date), ro0 AS (SELECT symbol, date, close / bench AS rs FROM bars JOIN bench USING (date)), ro1 AS (SELECT symbol, date, rs / {full('avg', 'rs', 40)} * 100 AS ratio FROM ro0),
ro2 AS (SELECT *, (ratio / lag(ratio, 10) {W} - 1) * 100 AS mom, lead(date) {W} IS NULL AS is_last FROM ro1)"""


@query("x13_rotation", with_(BARS["n"], _ROT, body="SELECT symbol, round(ratio, 4) AS rs_ratio, round(mom, 4) AS rs_momentum, CASE WHEN ratio > 100 AND mom > 0 THEN 'Leading' WHEN ratio > 100 AND mom < 0 THEN 'Weakening' WHEN ratio < 100 AND mom < 0 THEN 'Lagging' ELSE 'Improving' END AS quadrant FROM ro2 WHERE is_last AND ratio IS NOT NULL AND mom IS NOT NULL"))
def x13(spark, d):
    b = nation_bars(spark, d)
    return rounded(sn.rotation(b, index_close(b)))


# limits of the leaders are those of x11, so that the given data have some
_FIVE = {
    "rsi_scanner": registry.oversold(), "darvas_box": registry.boxes(), "momentum_squeeze": registry.squeezes(), "liquid_funds": registry.liquid_funds("nation"),
    "trend_leaders": registry.leaders(min_rs=30.0, min_template=3, min_proximity=0.05, min_rvol=0.2),
}
_UNION = """u AS (SELECT 'momentum_squeeze' AS strategy_name, CASE WHEN hist_color IN ('lime', 'green') THEN 1 ELSE -1 END AS action, CASE WHEN hist_color IN ('lime', 'red') THEN 1.0 ELSE 0.5 END AS conviction
   FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS fe FROM ms) WHERE v IS NOT NULL AND fe <= 10
 UNION ALL SELECT 'darvas_box', CASE WHEN darvas_signal LIKE 'Breakout%' THEN 1 ELSE -1 END, CASE WHEN vc THEN 1.0 ELSE 0.5 END FROM (SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) WHERE darvas_signal LIKE 'Break%'
 UNION ALL SELECT 'rsi_scanner', 1, round(least(1.0, greatest(0.0, (35 - rsi_14) / 25.0)), 2) FROM panel WHERE is_last AND rsi_14 < 35
 UNION ALL SELECT 'trend_leaders', 1, round(least(1.0, greatest(0.0, (rs_rating - 70) / 30.0)), 2) FROM lr WHERE rs_rating >= 30 AND template_score >= 3 AND high_proximity >= 0.05 AND rvol >= 0.2 AND stage2
 UNION ALL SELECT 'liquid_funds', 1, round(least(1.0, turnover / max(turnover) OVER ()), 2) FROM (SELECT p.*, nation FROM panel p JOIN master USING (symbol) WHERE is_last QUALIFY row_number() OVER (PARTITION BY nation ORDER BY turnover DESC, symbol DESC) = 1))"""
_METRICS = "SELECT strategy_name, count(*) AS signals, count(*) FILTER (WHERE action = 1) AS buys, count(*) FILTER (WHERE action = -1) AS sells, round(CAST(avg(conviction) AS DOUBLE), 4) AS avg_conviction FROM u GROUP BY strategy_name"


@query("x14_scanner_metrics", panel("s", MASTER, _MSQ, _DARVAS, _LEAD, _UNION, body=_METRICS))
def x14(spark, d):
    """Five scanners over all suppliers on one panel."""
    return rounded(sn.scanner_metrics(registry.scan(supplier_bars(spark, d), suppliers(spark, d), _FIVE)))


@query("x14_all_scanners")
def x14_all(spark, d):
    """The same with the pair scanner (pairs of LOOKBACK common bars), whose test SQL cannot say."""
    six = _FIVE | {"pair_scanner": registry.pair_trades(LOOKBACK)}
    return rounded(sn.scanner_metrics(registry.scan(supplier_bars(spark, d), suppliers(spark, d), six)))


@query("q6_anomalies")
def q6(spark, d):
    t = q.outlier_features(supplier_bars(spark, d)).select("symbol", "date", *q.OUTLIER_FEATURES)
    return anomaly.isolation_anomalies(t, q.OUTLIER_FEATURES)


_H20 = """hw AS (SELECT symbol, date, list(ln(close)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS w FROM panel),
hs AS (SELECT symbol, date, unnest([2, 3, 4]) AS k, w FROM hw WHERE len(w) = 20), hd AS (SELECT symbol, date, k, list_aggregate(list_transform(range(k + 1, 21), lambda i: w[i] - w[i - k]), 'stddev_samp') AS s FROM hs),
h20 AS (SELECT symbol, date, least(greatest(regr_slope(ln(s), ln(k)), 0), 1) AS h FROM hd WHERE s > 0 GROUP BY symbol, date)"""
_FEAT = f"""ft AS (SELECT symbol, date, close, close / lag(close) {W} - 1 AS return_1d, close / {_lag('close', 5)} - 1 AS return_5d, close / {_lag('close', 10)} - 1 AS return_10d, rsi_14, macd_hist, ln(close / lag(close) {W}) AS lr, deliv_pct, CAST(coalesce(lead(close) {W} > close, false) AS INTEGER) AS target FROM panel),
fv AS (SELECT ft.*, {full('stddev_samp', 'lr', 20).replace('symbol', 'ft.symbol').replace('date', 'ft.date')} AS vol_20d, coalesce(h, 0.5) AS hurst_20 FROM ft LEFT JOIN h20 ON h20.symbol = ft.symbol AND h20.date = ft.date),
feat AS (SELECT * FROM fv WHERE return_10d IS NOT NULL AND macd_hist IS NOT NULL AND vol_20d IS NOT NULL AND rsi_14 IS NOT NULL)"""
_FCOLS = ", ".join(f"round({x}, 4) AS {x}" for x in learn.FEATURES)


def _features(spark, d):
    return learn.feature_table(ind.recursive(supplier_bars(spark, d)))


_FALL = f"""fb AS (SELECT *, row_number() {W} - 1 AS bn, coalesce(greatest(close - lag(close) {W}, 0), 0) AS g, coalesce(greatest(lag(close) {W} - close, 0), 0) AS l FROM bars),
fe AS (SELECT symbol, bn, close AS ef, close AS es FROM fb WHERE bn = 0
  UNION ALL SELECT b.symbol, b.bn, e.ef + 2.0 / 13 * (b.close - e.ef), e.es + 2.0 / 27 * (b.close - e.es) FROM fe e JOIN fb b ON b.symbol = e.symbol AND b.bn = e.bn + 1),
fs AS (SELECT symbol, bn, ef - es AS mac, ef - es AS sig FROM fe WHERE bn = 0
  UNION ALL SELECT e.symbol, e.bn, e.ef - e.es, s.sig + 2.0 / 10 * (e.ef - e.es - s.sig) FROM fs s JOIN fe e ON e.symbol = s.symbol AND e.bn = s.bn + 1),
fr AS (SELECT symbol, date, bn, 100 - 100 / (1 + {full('avg', 'g', 14)} / ({full('avg', 'l', 14)} + 1e-9)) AS rsi_14, count(ln(close)) OVER (PARTITION BY symbol) AS n FROM fb)"""


@query("m1_fallback_features", with_(BARS["s"], _FALL, body="SELECT fr.symbol, fr.date, round(rsi_14, 4) AS rsi_14, round(mac - sig, 4) AS macd_hist FROM fr JOIN fs USING (symbol, bn) WHERE bn >= 20", recursive=True))
def m1_fallback(spark, d):
    """Features of bare bars: RSI of simple means, MACD histogram of exponential means from the first bar."""
    return rounded(learn.feature_table(supplier_bars(spark, d)).select("symbol", "date", "rsi_14", "macd_hist"))


@query("m1_features", panel("s", _H20, _FEAT, body=f"SELECT symbol, date, {_FCOLS}, target FROM feat"))
def m1(spark, d):
    return rounded(_features(spark, d).select("symbol", "date", *learn.FEATURES, "target"))


def _predicted(spark, d):
    # the fit passes over its rows many times: the features are written first
    return learn.fit_predict(written(learn.chronological(_features(spark, d))))


@query("m2_random_forest")
def m2(spark, d):
    return _predicted(spark, d)


@query("m3_forest_evaluation")
def m3_forest(spark, d):
    """The forest's own test rows, evaluated."""
    return rounded(learn.evaluate(_predicted(spark, d)))


@query("m4_forest_return")
def m4_forest(spark, d):
    """Return of holding where the forest expects a rise."""
    return rounded(pf.strategy_vs_hold(_predicted(spark, d), "prediction").select("symbol", "strategy_return", "hold_return"))


def _by_symbol(spark, d):
    return forests.fit_predict_by_symbol(learn.chronological(_features(spark, d)))


@query("m2_symbol_forests")
def m2_symbols(spark, d):
    """One forest per supplier instead of a pooled one."""
    return _by_symbol(spark, d)


@query("m3_symbol_evaluation")
def m3_symbols(spark, d):
    """The suppliers' own forests, evaluated on their own test rows."""
    return rounded(learn.evaluate(_by_symbol(spark, d)))


@query("m4_symbol_return")
def m4_symbols(spark, d):
    """Return of holding where a supplier's own forest expects a rise."""
    return rounded(pf.strategy_vs_hold(_by_symbol(spark, d), "prediction").select("symbol", "strategy_return", "hold_return"))


_SPLIT = "sp AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM feat), te AS (SELECT *, CAST(rsi_14 > 50 AS INTEGER) AS prediction FROM sp WHERE rn > floor(n * 0.8))"


def _baseline(spark, d):
    """Test rows with a rule prediction (RSI above 50), so that the evaluation has an exact SQL twin."""
    t = learn.chronological(_features(spark, d)).filter(~c.is_train)
    return t.withColumn("prediction", truth(c.rsi_14 > 50).cast("int"))


@query("m3_evaluation", panel("s", _H20, _FEAT, _SPLIT, body="""SELECT symbol, count(*) AS n, round(count(*) FILTER (WHERE prediction = target) / count(*), 4) AS accuracy, round(coalesce(count(*) FILTER (WHERE prediction = 1 AND target = 1) / nullif(count(*) FILTER (WHERE prediction = 1), 0), 0), 4) AS precision,
  round(coalesce(count(*) FILTER (WHERE prediction = 1 AND target = 1) / nullif(count(*) FILTER (WHERE target = 1), 0), 0), 4) AS recall FROM te GROUP BY symbol"""))
def m3(spark, d):
    return rounded(learn.evaluate(_baseline(spark, d)))


@query("m4_strategy_return", panel("s", _H20, _FEAT, _SPLIT, f"tr AS (SELECT symbol, date, close, coalesce(lag(prediction) {W} * (close / lag(close) {W} - 1), 0) AS sr FROM te)",
  body="SELECT symbol, round(exp(sum(ln(1 + sr))) - 1, 4) AS strategy_return, round(arg_max(close, date) / arg_min(close, date) - 1, 4) AS hold_return FROM tr GROUP BY symbol"))
def m4(spark, d):
    return rounded(pf.strategy_vs_hold(_baseline(spark, d), "prediction").select("symbol", "strategy_return", "hold_return"))


