"""Risk metrics, sizing, portfolio tables, scoring and corporate overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rank, ts
from ..functions.num import c, rnd
from ..operators import corporate as corp
from ..operators import garch
from ..operators import indicators as ind
from ..operators import portfolio as pf
from ..operators import risk
from ..operators import scoring as sc
from ..operators import trend as tr
from ..session import written
from ..sources import bars as B
from .catalog import query
from .q_trend import CAR, D200
from .sqltext import BARS, MASTER, SOFAR, W, panel, with_
from .tables import index_close, nation_bars, rounded, segment_bars, supplier_bars, supplier_panel, suppliers, table

_FE = "row_number() OVER (PARTITION BY symbol ORDER BY date DESC)"
_R0 = f"""r0 AS (SELECT symbol, date, close, {_FE} - 1 AS age, count(*) OVER (PARTITION BY symbol) AS n, ln(close / lag(close) {W}) AS lr FROM bars)"""
_RISK = f"""{_R0},
dd AS (SELECT *, (close - max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) * 100.0 AS d FROM r0 WHERE age < 252),
ra AS (SELECT symbol, max(n) AS n, min(d) AS dd, count(lr) AS nr, avg(lr) AS mu, stddev_samp(lr) AS sd, arg_min(close, date) AS c0, arg_max(close, date) AS c1, count(*) AS days,
  quantile_cont(lr, 0.05) FILTER (WHERE age < 251) AS p05, count(lr) FILTER (WHERE age < 251) AS nv FROM dd GROUP BY symbol),
risk AS (SELECT symbol, CASE WHEN n >= 2 THEN dd END AS max_drawdown_pct, CASE WHEN nr >= 30 AND n >= 31 AND sd > 0 THEN round((mu - 0.06 / 252) / sd * sqrt(252), 4) END AS sharpe_1y,
  CASE WHEN days >= 2 AND dd <> 0 THEN round((pow(c1 / c0, 252.0 / days) - 1) / abs(dd / 100.0), 4) END AS calmar_1y, CASE WHEN nv >= 5 THEN round(abs(p05) * 100.0, 4) END AS var_95_pct FROM ra)"""
_BENCH = "bench AS (SELECT date, avg(close) AS bench FROM bars GROUP BY date)"
_BETA = f"""bm AS (SELECT * FROM bench ORDER BY date DESC LIMIT 253),
bj AS (SELECT b.symbol, b.date, b.close, m.bench FROM (SELECT *, {_FE} AS fe FROM bars) b JOIN bm m ON b.date = m.date WHERE b.fe <= 253),
bl AS (SELECT symbol, ln(close / lag(close) {W}) AS rs, ln(bench / lag(bench) {W}) AS rb FROM bj),
beta AS (SELECT symbol, CASE WHEN count(*) >= 30 AND count(rs) >= 30 THEN round(covar_samp(rs, rb) / nullif(var_samp(rb), 0), 4) END AS beta FROM bl GROUP BY symbol)"""


def _risk(spark, d):
    return risk.risk_table(supplier_bars(spark, d))


for _n, _col in (("r1_max_drawdown", "max_drawdown_pct"), ("r2_sharpe", "sharpe_1y"), ("r3_calmar", "calmar_1y")):

    def _mk(name, col):
        @query(name, with_(BARS["s"], _RISK, body=f"SELECT symbol, round({col}, 4) AS {col} FROM risk"))
        def run(spark, d):
            return rounded(_risk(spark, d).select("symbol", col))

    _mk(_n, _col)


@query("r4_beta", with_(BARS["s"], _BENCH, _BETA, body="SELECT symbol, beta FROM beta"))
def r4(spark, d):
    b = supplier_bars(spark, d)
    return risk.beta(b, index_close(b))


@query("r5_risk_badge", with_(BARS["s"], _RISK, _BENCH, _BETA, body="""SELECT symbol, CASE WHEN sharpe_1y >= 1.5 THEN '⭐' WHEN sharpe_1y >= 0.5 THEN '📊' ELSE '⚠️ ' END || ' ' || concat_ws(' | ', symbol,
  CASE WHEN sharpe_1y IS NOT NULL THEN printf('Sharpe=%.2f', round(sharpe_1y, 2)) END, CASE WHEN calmar_1y IS NOT NULL THEN printf('Calmar=%.2f', round(calmar_1y, 2)) END,
  CASE WHEN beta IS NOT NULL THEN printf('Beta=%.2f', round(beta, 2)) END, CASE WHEN max_drawdown_pct IS NOT NULL THEN printf('MaxDD=%.2f%%', round(max_drawdown_pct, 2)) END) AS risk_badge
  FROM risk LEFT JOIN beta USING (symbol)"""))
def r5(spark, d):
    b = written(supplier_bars(spark, d))  # trades become bars once, for the risk table, the index and beta
    return risk.risk_badge(risk.risk_table(b).join(risk.beta(b, index_close(b)), "symbol", "left")).select("symbol", "risk_badge")


_HURST = f"""lp AS (SELECT symbol, date, ln(close) AS l FROM bars),
hl AS (SELECT symbol, k, stddev_samp(dl) AS s FROM (SELECT symbol, {", ".join(f"l - lag(l, {k}) {W} AS d{k}" for k in range(2, 20))} FROM lp)
  UNPIVOT (dl FOR k IN ({", ".join(f"d{k}" for k in range(2, 20))})) GROUP BY symbol, k),
hurst AS (SELECT symbol, least(greatest(coalesce(regr_slope(ln(s), ln(CAST(substr(k, 2) AS DOUBLE))), 0.5), 0), 1) AS hurst FROM hl WHERE s > 0 GROUP BY symbol
  HAVING symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 25))"""


@query("r6_hurst", with_(BARS["s"], _HURST, body="SELECT symbol, round(hurst, 4) AS hurst FROM hurst"))
def r6(spark, d):
    return rounded(risk.hurst(supplier_bars(spark, d)))


@query("r7_hurst_label", with_(BARS["s"], _HURST, body="SELECT symbol, CASE WHEN hurst > 0.6 THEN 'Trending' WHEN hurst < 0.4 THEN 'Mean-reverting' ELSE 'Random walk' END AS hurst_label FROM hurst"))
def r7(spark, d):
    return risk.hurst(supplier_bars(spark, d)).select("symbol", risk.hurst_label(c.hurst).alias("hurst_label"))


@query("r8_hist_var", with_(BARS["s"], _RISK, body="SELECT symbol, var_95_pct, coalesce(var_95_pct > 3, false) AS severe FROM risk"))
def r8(spark, d):
    return _risk(spark, d).select("symbol", "var_95_pct", F.coalesce(c.var_95_pct > 3, F.lit(False)).alias("severe"))


@query("r9_garch_fit")
def r9_fit(spark, d):
    """Maximum-likelihood parameters of every supplier."""
    return rounded(garch.fitted(supplier_bars(spark, d)))


_GARCH = f"""gr0 AS (SELECT symbol, date, ln(close / lag(close) {W}) * 100.0 AS r FROM bars), gr1 AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, r, avg(r) OVER (PARTITION BY symbol) AS mu FROM gr0 WHERE r IS NOT NULL),
gs AS (SELECT symbol, count(*) AS n, any_value(mu) AS mu, avg((r - mu) * (r - mu)) AS v, sum(pow(0.94, i) * (r - mu) * (r - mu)) FILTER (i < 75) / sum(pow(0.94, i)) FILTER (i < 75) AS back FROM gr1 GROUP BY symbol HAVING count(*) >= 60),
gh AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, back AS h, back AS e2, CAST(0 AS DOUBLE) AS ll FROM gs
  UNION ALL SELECT g.symbol, g.i, s.v * 0.08 + 0.07 * p.e2 + 0.85 * p.h, (g.r - s.mu) * (g.r - s.mu),
    p.ll - 0.5 * (ln(2 * pi()) + ln(s.v * 0.08 + 0.07 * p.e2 + 0.85 * p.h) + (g.r - s.mu) * (g.r - s.mu) / (s.v * 0.08 + 0.07 * p.e2 + 0.85 * p.h))
  FROM gh p JOIN gr1 g ON g.symbol = p.symbol AND g.i = p.i + 1 JOIN gs s ON s.symbol = g.symbol)"""


@query("r9_garch_likelihood", with_(BARS["s"], _GARCH, body="SELECT symbol, n, round(mu, 4) AS mu, round(v, 4) AS variance, round(back, 4) AS backcast, round(ll, 4) AS loglik FROM gs JOIN gh USING (symbol) WHERE gh.i = n - 1", recursive=True))
def r9_likelihood(spark, d):
    """The likelihood that the fit climbs, at one point (alpha 0.07, beta 0.85) of every supplier."""
    return rounded(garch.loglik_at(supplier_bars(spark, d), 0.07, 0.85))


@query("r9_vol_regime")
def r9(spark, d):
    return risk.vol_regime(supplier_bars(spark, d))


_H20 = f"""hw AS (SELECT symbol, date, list(ln(close)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS w FROM bars),
hs AS (SELECT symbol, date, unnest([2, 3, 4]) AS k, w FROM hw WHERE len(w) = 20),
hd AS (SELECT symbol, date, k, list_aggregate(list_transform(range(k + 1, 21), lambda i: w[i] - w[i - k]), 'stddev_samp') AS s FROM hs),
h20 AS (SELECT symbol, date, least(greatest(regr_slope(ln(s), ln(k)), 0), 1) AS h FROM hd WHERE s > 0 GROUP BY symbol, date)"""


@query("r10_rolling_hurst", with_(BARS["s"], _H20, body="SELECT b.symbol, b.date, round(coalesce(h, 0.5), 4) AS hurst_20 FROM bars b LEFT JOIN h20 ON b.symbol = h20.symbol AND b.date = h20.date"))
def r10(spark, d):
    return rounded(risk.rolling_hurst(supplier_bars(spark, d)).select("symbol", "date", "hurst_20"))


_SEG = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query("r11_correlation_matrix", with_(BARS["g"], f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)),
ix AS (SELECT b.symbol, b.date, c.i, close, lag(c.i) OVER (PARTITION BY symbol ORDER BY b.date) AS pi, close / lag(close) OVER (PARTITION BY symbol ORDER BY b.date) - 1 AS ret FROM bars b JOIN cal c USING (date)),
ok AS (SELECT * FROM ix WHERE pi = i - 1), full_days AS (SELECT date FROM ok GROUP BY date HAVING count(*) = {len(_SEG)}),
x AS (SELECT ok.* FROM ok JOIN full_days USING (date))""",
  "k AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, CASE WHEN a.symbol = b.symbol THEN CASE WHEN count(*) > 1 THEN 1.0 END ELSE round(corr(a.ret, b.ret), 4) END AS corr FROM x a JOIN x b ON a.date = b.date GROUP BY a.symbol, b.symbol)",
  f"s6 AS (SELECT unnest({_SEG}) AS s)",
  body="SELECT p.s AS symbol_a, q.s AS symbol_b, k.corr FROM s6 p CROSS JOIN s6 q LEFT JOIN k ON k.symbol_a = p.s AND k.symbol_b = q.s"))
def r11(spark, d):
    return rounded(risk.correlation_matrix(segment_bars(spark, d), _SEG))


_HELD = ["1", "2", "3"]


@query("r12_held_correlation", with_(BARS["s"], f"""q AS (SELECT symbol, date, close / lag(close) {W} - 1 AS ret, {_FE} AS fe, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
t AS (SELECT * FROM q WHERE fe <= 30 AND n >= 30), pc AS (SELECT a.symbol, h.symbol AS held, corr(a.ret, h.ret) AS k FROM t a LEFT JOIN t h ON a.date = h.date AND h.symbol IN ('1', '2', '3') WHERE a.symbol NOT IN ('1', '2', '3') GROUP BY 1, 2)""",
  body="SELECT symbol, round(max(CASE WHEN isfinite(k) THEN k END), 4) AS max_corr, coalesce(max(CASE WHEN isfinite(k) THEN k END) <= 0.8, true) AS accepted FROM pc GROUP BY symbol"))
def r12(spark, d):
    return rounded(risk.held_correlation(supplier_bars(spark, d), _HELD))


# ---- sizing, costs, portfolio ------------------------------------------------


@query("z1_position_size", panel("s", body="""SELECT symbol, CASE WHEN atr_14 > 0 THEN floor(5000.0 / (1.5 * atr_14)) END AS suggested_qty, CASE WHEN atr_14 > 0 THEN round(close - 1.5 * atr_14, 2) END AS stop_price,
  CASE WHEN atr_14 > 0 THEN CAST(5000.0 AS DOUBLE) END AS risk_amount, CASE WHEN atr_14 > 0 THEN round(floor(5000.0 / (1.5 * atr_14)) * close, 2) END AS position_value, CASE WHEN atr_14 > 0 THEN round(close + 3.0 * atr_14, 2) END AS rr_target FROM panel WHERE is_last"""))
def z1(spark, d):
    s = ts.latest(ind.recursive(supplier_bars(spark, d)))
    return pf.position_size(s).select("symbol", "suggested_qty", "stop_price", "risk_amount", "position_value", "rr_target")


@query("z2_trade_cost", """SELECT l_orderkey, l_linenumber, l_partkey, side, round(v * 0.0000345 + v * 0.000001 + v * 0.001 + CASE WHEN side = 'BUY' THEN v * 0.00015 ELSE 0 END + v * 0.0000345 * 0.18, 4) AS cost FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side FROM lineitem)""")
def z2(spark, d):
    l = table(spark, d, "lineitem").withColumn("side", F.when(c.l_returnflag == "R", "SELL").otherwise("BUY"))
    return rounded(l.select("l_orderkey", "l_linenumber", "l_partkey", "side", pf.trade_cost(c.l_extendedprice / c.l_quantity, c.l_quantity, c.side).alias("cost")))


def positions(spark, d):
    """One position per supplier: entry at the mean traded price, current price at the latest close."""
    b = supplier_bars(spark, d)
    p = b.groupBy("symbol").agg(
        F.sum("volume").alias("qty"), rnd(F.sum("turnover") / F.sum("volume"), 6).alias("entry_price"), F.max_by("close", "date").alias("current_price")
    )
    p = p.withColumns({"stop_price": c.entry_price * 0.9, "target_price": c.entry_price * 1.2})
    return p.join(suppliers(spark, d).select("symbol", "sector"), "symbol", "left")


_POS = """pos AS (SELECT p.*, sector, entry_price * 0.9 AS stop_price, entry_price * 1.2 AS target_price FROM (SELECT symbol, sum(volume) AS qty, round(sum(turnover) / sum(volume), 6) AS entry_price, arg_max(close, date) AS current_price FROM bars GROUP BY symbol) p LEFT JOIN master USING (symbol)),
tot AS (SELECT sum(qty * current_price) + 1000000 AS total FROM pos)"""


@query("z3_position_table", with_(BARS["s"], MASTER, _POS, body="""SELECT symbol, sector, qty, round(entry_price, 2) AS entry_price, round(qty * current_price, 2) AS current_value, round(qty * current_price - qty * entry_price, 2) AS pnl,
  round((qty * current_price - qty * entry_price) / (qty * entry_price) * 100.0, 2) AS pnl_pct FROM pos"""))
def z3(spark, d):
    return pf.position_table(positions(spark, d)).select("symbol", "sector", "qty", rnd("entry_price", 2).alias("entry_price"), "current_value", "pnl", "pnl_pct")


@query("z4_sector_exposure", with_(BARS["s"], MASTER, _POS, body="""SELECT 'sector' AS kind, sector AS name, round(sum(qty * current_price), 2) AS value, round(sum(qty * current_price) / max(total), 6) AS share, sum(qty * current_price) / max(total) > 0.25 AS breach FROM pos, tot GROUP BY sector
 UNION ALL SELECT 'single', symbol, round(qty * current_price, 2), round(qty * current_price / total, 6), qty * current_price / total > 0.10 FROM pos, tot"""))
def z4(spark, d):
    p = written(positions(spark, d))
    a = pf.sector_exposure(p, 1_000_000.0).select(F.lit("sector").alias("kind"), F.col("sector").alias("name"), rnd("exposure", 2).alias("value"), rnd("share", 6).alias("share"), "breach")
    b = pf.single_exposure(p, 1_000_000.0).select(F.lit("single").alias("kind"), F.col("symbol").alias("name"), rnd("value", 2).alias("value"), rnd("share", 6).alias("share"), "breach")
    return a.unionByName(b)


@query("z5_portfolio_heat", with_(BARS["s"], MASTER, _POS, body="""SELECT round(sum((entry_price - stop_price) * qty), 2) AS at_risk, round(sum(qty * current_price) + 1000000, 2) AS total, round(sum((entry_price - stop_price) * qty) / (sum(qty * current_price) + 1000000), 6) AS heat FROM pos"""))
def z5(spark, d):
    return pf.heat(positions(spark, d), 1_000_000.0).select(rnd("at_risk", 2).alias("at_risk"), rnd("total", 2).alias("total"), rnd("heat", 6).alias("heat"))


@query("z6_exit_flags", with_(BARS["s"], MASTER, _POS, body="""SELECT symbol, CASE WHEN current_price <= stop_price THEN 'Stop Loss Triggered' WHEN current_price >= target_price THEN 'Target Reached' ELSE 'Hold' END AS exit_reason FROM pos"""))
def z6(spark, d):
    return pf.exit_flags(positions(spark, d), B.latest_bars(supplier_bars(spark, d))).select("symbol", "exit_reason")


_RULES_SQL = {
    "turtle": ("close >= prev_high_55", "close <= low_20"),
    "sma100": ("close > sma_100", "close < sma_100"),
    "rdx": ("adx_14 > 25 AND plus_di_14 > minus_di_14 AND rsi_14 > 60", "plus_di_14 < minus_di_14 OR rsi_14 < 45"),
    "rsi": ("rsi_14 < 30", "rsi_14 > 50"),
    "dmadma": ("close > sma_200 AND sma_200 > sma_150", "close < sma_200"),
}
# the oracle walks bar by bar, as the rule is stated
_WALK = "ev AS (SELECT symbol, date, close, bn, " + ", ".join(f"coalesce({e}, false) AS e_{k}, coalesce({x}, false) AS x_{k}" for k, (e, x) in _RULES_SQL.items()) + """ FROM panel),
walk AS (SELECT symbol, bn, date, """ + ", ".join(f"CASE WHEN e_{k} THEN 1 ELSE 0 END AS p_{k}" for k in _RULES_SQL) + """ FROM ev WHERE bn = 0
 UNION ALL SELECT e.symbol, e.bn, e.date, """ + ", ".join(f"CASE WHEN w.p_{k} = 0 AND e_{k} THEN 1 WHEN w.p_{k} = 1 AND x_{k} THEN 0 ELSE w.p_{k} END" for k in _RULES_SQL) + """ FROM walk w JOIN ev e ON e.symbol = w.symbol AND e.bn = w.bn + 1)"""


def _rules_panel(spark, d):
    return pf.rule_positions(ind.indicators(supplier_bars(spark, d)), {f"p_{name}": rule for name, rule in pf.rules().items()})


@query("z7_rule_positions", panel("s", _WALK, body="SELECT symbol, date, " + ", ".join(f"p_{k}" for k in _RULES_SQL) + " FROM walk"))
def z7(spark, d):
    return _rules_panel(spark, d).select("symbol", "date", *[f"p_{k}" for k in pf.rules()])


@query("z8_strategy_vs_hold", panel("s", _WALK, f"""zr AS (SELECT w.symbol, w.date, e.close, coalesce(lag(p_rsi) OVER w1 * (e.close / lag(e.close) OVER w1 - 1), 0) AS sr FROM walk w JOIN ev e ON e.symbol = w.symbol AND e.bn = w.bn WINDOW w1 AS (PARTITION BY w.symbol ORDER BY w.bn)),
ze AS (SELECT *, exp(sum(ln(1 + sr)) {SOFAR}) AS eq FROM zr), zd AS (SELECT *, eq / max(eq) {SOFAR} - 1 AS dd FROM ze)""",
  body="SELECT symbol, round(arg_max(eq, date) - 1, 4) AS strategy_return, round(arg_max(close, date) / arg_min(close, date) - 1, 4) AS hold_return, round(min(dd), 4) AS max_drawdown FROM zd GROUP BY symbol"))
def z8(spark, d):
    p = ind.recursive(supplier_bars(spark, d))
    entry, exit_ = pf.rules()["rsi"]
    return rounded(pf.strategy_vs_hold(pf.rule_position(p, entry, exit_)))


# ---- scoring -----------------------------------------------------------------

_CORP_BASE = """docs AS (SELECT CAST(doc_id % (SELECT count(*) FROM supplier) + 1 AS VARCHAR) AS symbol, text, source, n_chars FROM documents)"""
_FACT = """fin AS (SELECT d2.*, car_rating, sharpe_1y, max_drawdown_pct, CASE WHEN acctbal > 0 THEN acctbal / 100.0 END AS garch_vol_pct, CAST(length(name) % 5 - 2 AS INTEGER) AS insider_score, CAST(length(nation) AS INTEGER) AS event_days
  FROM d2 JOIN car USING (symbol) LEFT JOIN risk USING (symbol) LEFT JOIN master USING (symbol) WHERE is_last),
fs AS (SELECT symbol,
  CASE WHEN close > sma_20 THEN 10.0 ELSE 0 END + CASE WHEN sma_20 > sma_50 THEN 10 ELSE 0 END + CASE WHEN sma_50 > sma_100 THEN 10 ELSE 0 END + CASE WHEN sma_100 > sma_150 THEN 10 ELSE 0 END + CASE WHEN sma_150 > sma_200 THEN 10 ELSE 0 END
   + CASE WHEN diff_200 > 0 AND diff_200 <= 10 THEN 50 WHEN diff_200 > 10 AND diff_200 <= 20 THEN 35 WHEN diff_200 > 20 AND diff_200 <= 30 THEN 15 ELSE 0 END AS trend_score,
  CASE WHEN rsi_14 BETWEEN 55 AND 70 THEN 50.0 WHEN rsi_14 >= 45 AND rsi_14 < 55 THEN 30 WHEN rsi_14 > 70 AND rsi_14 <= 80 THEN 20 WHEN rsi_14 >= 35 AND rsi_14 < 45 THEN 10 ELSE 0 END
   + CASE WHEN adx_14 > 25 AND plus_di_14 > minus_di_14 THEN 50 WHEN adx_14 > 20 AND plus_di_14 > minus_di_14 THEN 35 WHEN plus_di_14 > minus_di_14 THEN 15 ELSE 0 END AS momentum_score,
  CASE WHEN car_rating = 'Buy/Average Out' THEN 100.0 ELSE 20 END AS car_score,
  CASE WHEN sharpe_1y >= 2 THEN 50.0 WHEN sharpe_1y >= 1 THEN 35 WHEN sharpe_1y >= 0.5 THEN 15 ELSE 0 END + CASE WHEN abs(max_drawdown_pct) <= 10 THEN 50 WHEN abs(max_drawdown_pct) <= 20 THEN 35 WHEN abs(max_drawdown_pct) <= 35 THEN 15 ELSE 0 END AS risk_score,
  CASE WHEN deliv_pct >= 45 THEN 50.0 WHEN deliv_pct >= 30 THEN 35 WHEN deliv_pct >= 20 THEN 15 ELSE 0 END + CASE WHEN vol_spike >= 2.5 THEN 50 WHEN vol_spike >= 1.5 THEN 35 WHEN vol_spike >= 1 THEN 15 ELSE 0 END AS volume_score,
  CASE WHEN garch_vol_pct <= 20 THEN 100.0 WHEN garch_vol_pct <= 35 THEN 75 WHEN garch_vol_pct <= 50 THEN 40 ELSE 10 END AS volatility_score,
  least(100.0, 30 + CASE WHEN insider_score > 0 THEN 40 ELSE 0 END + CASE WHEN event_days > 0 AND event_days <= 10 THEN 30 ELSE 10 END) AS catalyst_score FROM fin)"""


def _score_input(spark, d):
    """Latest bar, CAR, risk, and stand-ins for the filings and the volatility from the supplier master."""
    b = written(supplier_bars(spark, d))  # trades become bars once, for the panel, the ratings and the risk table
    s = tr.diff_200(ind.latest_indicators(b))
    m = suppliers(spark, d).select(
        "symbol",
        F.when(c.acctbal > 0, c.acctbal / 100.0).alias("garch_vol_pct"),
        (F.length("name") % 5 - 2).alias("insider_score"),
        F.length("nation").alias("event_days"),
    )
    return s.join(tr.car_rating(b), "symbol").join(risk.risk_table(b), "symbol", "left").join(m, "symbol", "left")


_FACTORS = {"f1_trend": "trend", "f2_momentum": "momentum", "f3_car": "car", "f4_risk": "risk", "f5_volume": "volume", "f6_volatility": "volatility", "f7_catalyst": "catalyst"}
for _n, _f in _FACTORS.items():

    def _mk2(name, f):
        @query(name + "_factor", panel("s", D200, CAR, _RISK, MASTER, _FACT, body=f"SELECT symbol, CAST({f}_score AS DOUBLE) AS {f}_score FROM fs"))
        def run(spark, d):
            return sc.factors(_score_input(spark, d)).select("symbol", f"{f}_score")

    _mk2(_n, _f)

_COMP = " + ".join(f"{f}_score * CAST({w} AS DOUBLE)" for f, w in sc.WEIGHTS.items())


@query("f8_composite_rank", panel("s", D200, CAR, _RISK, MASTER, _FACT, f"cs AS (SELECT symbol, round({_COMP}, 4) AS composite_score FROM fs)",
  body="SELECT symbol, composite_score, rank() OVER (ORDER BY composite_score DESC) AS rank FROM cs"))
def f8(spark, d):
    t = sc.composite(_score_input(spark, d)).select("symbol", rnd("composite_score").alias("composite_score"))
    return rank.min_rank(t, "composite_score", "rank")


# ---- corporate overlays --------------------------------------------------------


def _docs(spark, d):
    """Announcements: documents spread over the suppliers by id."""
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("_n"))
    return table(spark, d, "documents").join(F.broadcast(n), F.lit(True)).select(
        (c.doc_id % F.col("_n") + 1).cast("string").alias("symbol"), "text", "source", "n_chars"
    )


_TAGS = {"Div": ["que"], "Split": ["und", "sub-division"], "Bonus": ["ing"]}


@query("e1_action_tags", with_(_CORP_BASE, "t AS (SELECT symbol, bool_or(contains(lower(text), 'que')) AS dv, bool_or(contains(lower(text), 'und') OR contains(lower(text), 'sub-division')) AS sp, bool_or(contains(lower(text), 'ing')) AS bo FROM docs GROUP BY symbol)",
  body="SELECT symbol, coalesce(nullif(concat_ws(', ', CASE WHEN bo THEN 'Bonus' END, CASE WHEN dv THEN 'Div' END, CASE WHEN sp THEN 'Split' END), ''), 'None') AS corp_action FROM t"))
def e1(spark, d):
    return corp.action_tags(_docs(spark, d).withColumn("subject", c.text), _TAGS)


@query("e2_catalyst", with_(_CORP_BASE, body="""SELECT symbol, CASE WHEN bool_or(contains(t, 'order') OR contains(t, 'acquisition') OR contains(t, 'financial results') OR contains(t, 'fund raising') OR contains(t, 'upgrade')) THEN 'Yes' ELSE 'No' END AS catalyst
  FROM (SELECT symbol, lower(source || ' ' || text) AS t FROM docs) GROUP BY symbol"""))
def e2(spark, d):
    return corp.catalyst(_docs(spark, d).select("symbol", c.source.alias("desc"), c.text.alias("subject")))


@query("e3_days_to_event", """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(coalesce(date_diff('day', DATE '2000-06-30', min(CASE WHEN CAST(l_shipdate AS DATE) >= DATE '2000-06-30' THEN CAST(l_shipdate AS DATE) END)), -1) AS INTEGER) AS event_days FROM lineitem GROUP BY l_suppkey""")
def e3(spark, d):
    ev = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.date_format("l_shipdate", "dd-MMM-yyyy").alias("event_date"))
    return corp.days_to_event(ev, F.lit("2000-06-30").cast("date"))


@query("e4_insider_score", """SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(greatest(-3, least(3, sum(CASE WHEN event_type = 'purchase' THEN CASE WHEN value * 100000 > 10000000 THEN 3 ELSE 1 END WHEN event_type = 'error' THEN -2 WHEN event_type = 'signup' THEN -3 ELSE 0 END))) AS INTEGER) AS insider_score
  FROM events GROUP BY user_id""")
def e4(spark, d):
    e = table(spark, d, "events")
    mode = F.when(c.event_type == "purchase", "Market Purchase").when(c.event_type == "error", "Market Sale").when(c.event_type == "signup", "Pledge Creation").otherwise("ESOP")
    return corp.insider_score(e.select(F.col("user_id").cast("string").alias("symbol"), F.lit("Promoter Group").alias("person_category"), mode.alias("acq_mode"), (c.value * 100000).cast("string").alias("sec_val")))
