"""Data quality and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions.num import c, rnd
from ..operators import indicators as ind
from ..operators import quality as q
from ..sources import bars as B
from .catalog import query
from .sqltext import BARS, W, with_
from .tables import rounded, supplier_bars, table

AS_OF = "2001-12-01"
_COV = """cov0 AS (SELECT symbol, count(*) AS n, min(date) AS d0, max(date) AS d1, bool_or(volume = 0) AS zv, bool_or(close = 0) AS zc, floor(date_diff('day', min(date), max(date)) / 365.25 * 252) AS e FROM bars GROUP BY symbol),
cov AS (SELECT *, CASE WHEN e > 20 THEN least(100.0, round(n / e * 100.0, 1)) ELSE 100.0 END AS coverage_pct FROM cov0)"""
_STATUS = "CASE WHEN n < 2 THEN 'INSUFFICIENT_HISTORY' WHEN coverage_pct < 85 THEN 'LOW_COVERAGE' WHEN zv THEN 'ZERO_VOLUME' WHEN zc THEN 'ZERO_CLOSE' ELSE 'HEALTHY' END"


@query("q1_coverage", with_(BARS["s"], _COV, body=f"SELECT symbol, n AS rows, d0 AS first_date, d1 AS last_date, CAST(coverage_pct AS DOUBLE) AS coverage_pct, {_STATUS} AS dq_status FROM cov"))
def q1(spark, d):
    return q.coverage(supplier_bars(spark, d))


@query("q2_status_table", with_(BARS["s"], _COV, body="SELECT CAST(c_custkey AS VARCHAR) AS symbol, coalesce(n, 0) AS rows, coalesce(coverage_pct >= 20, false) AS healthy FROM customer LEFT JOIN cov ON symbol = CAST(c_custkey AS VARCHAR)"))
def q2(spark, d):
    req = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"))
    return q.status_table(req, q.coverage(supplier_bars(spark, d)), healthy=20.0).select("symbol", "rows", "healthy")


_RAW = """raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS open, l_extendedprice * (1 + l_tax) / l_quantity AS high, l_extendedprice * (1 - l_discount) / l_quantity AS low,
  CASE WHEN l_linenumber = 7 AND l_quantity > 40 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber = 6 AND l_quantity > 40 THEN -1.0 ELSE l_extendedprice * (1.03 - l_discount) / l_quantity END AS close, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS volume FROM lineitem)"""
_CELLS = ("open", "high", "low", "close", "volume")


def raw_rows(spark, d):
    """One row per trade in the shape of a bar: dates repeat, some cells are missing, infinite or out of bounds."""
    t = table(spark, d, "lineitem")
    p = c.l_extendedprice
    close = F.when((c.l_linenumber == 7) & (c.l_quantity > 40), float("inf")).when((c.l_linenumber == 6) & (c.l_quantity > 40), -1.0).otherwise(p * (1.03 - c.l_discount) / c.l_quantity)
    return t.select(
        c.l_suppkey.cast("string").alias("symbol"), c.l_shipdate.cast("date").alias("date"), (p / c.l_quantity).alias("open"), (p * (1 + c.l_tax) / c.l_quantity).alias("high"), (p * (1 - c.l_discount) / c.l_quantity).alias("low"),
        close.alias("close"), F.when((c.l_returnflag == "R") & (c.l_quantity > 45), None).otherwise(c.l_quantity.cast("double")).alias("volume"),
    )


@query("q3_integrity", with_(_RAW, "x AS (SELECT *, date_diff('day', lag(date) OVER w, date) AS gap, close / lag(close) OVER w - 1 AS ret FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY date, close, volume NULLS FIRST))", body="SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT date) AS duplicate_rows, "
  + ", ".join(f"count(*) FILTER (WHERE {x} IS NULL OR isnan({x})) AS null_{x}, count(*) FILTER (WHERE isinf({x})) AS inf_{x}" for x in _CELLS)
  + ", " + " + ".join(f"count(*) FILTER (WHERE {x} <= 0)" for x in _CELLS[:4]) + " AS non_positive, " + " + ".join(f"count(*) FILTER (WHERE {x})" for x in ("high < low", "open > high", "close > high", "open < low", "close < low"))
  + " AS bound_violations, count(*) FILTER (WHERE abs(ret) > 0.5 AND NOT isnan(ret)) AS extreme_returns, count(*) FILTER (WHERE gap > 7) AS long_gaps FROM x GROUP BY symbol"))
def q3(spark, d):
    return q.integrity(raw_rows(spark, d))


@query("q4_bad_row_filter", with_(BARS["s"], f"x AS (SELECT *, lag(close) {W} AS pc FROM bars WHERE volume > 0)", body="SELECT symbol, date, round(close, 4) AS close FROM x WHERE (pc IS NULL OR abs(open / pc - 1) < 0.25) AND close > 0"))
def q4(spark, d):
    return rounded(q.drop_bad_rows(supplier_bars(spark, d)).select("symbol", "date", "close"))


_OUT = f"""o0 AS (SELECT *, open / lag(close) {W} - 1 AS g, close / lag(close) {W} - 1 AS r, CASE WHEN count(*) OVER w = 20 THEN avg(volume) OVER w END AS vm, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(volume) OVER w END AS vs FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))"""


@query("q5_outlier_features", with_(BARS["s"], _OUT, body="SELECT symbol, date, round(coalesce(g, 0), 4) AS gap, round(coalesce(r, 0), 4) AS ret, round((high - low) / close, 4) AS hl_spread, round(coalesce((volume - vm) / (vs + 1e-9), 0), 4) AS vol_z FROM o0"))
def q5(spark, d):
    return rounded(q.outlier_features(supplier_bars(spark, d)).select("symbol", "date", *q.OUTLIER_FEATURES))


_NEAR = "least(" + ", ".join(f"abs(ratio - {x})" for x in ("0.5", "0.2", "0.1", "CAST(1 AS DOUBLE) / 1.5", "0.8", "CAST(1 AS DOUBLE) / 3", "0.25")) + ") < 0.05"
_RULE = f"CASE WHEN (ratio < 0.8 OR ratio > 2) AND {_NEAR} THEN 'CORP_ACTION' WHEN ratio < 0.8 THEN 'BAD_TICK' ELSE 'OK' END"
_GATE = f"""g0 AS (SELECT *, lag(close) {W} AS pc, close / lag(close) {W} - 1 AS r, (high - low) / close > 0.6 AS flag FROM bars),
g1 AS (SELECT *, close / pc AS ratio, count(*) OVER a AS before, count(*) OVER k AS n, sum(r) OVER m AS s, sum(r * r) OVER m AS ss FROM g0
  WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)),
g2 AS (SELECT *, s / n AS mean, CASE WHEN n > 1 AND ss - s * (s / n) >= 0 THEN sqrt((ss - s * (s / n)) / (n - 1)) END AS dev, ratio < 0.8 OR ratio > 1.2 AS extreme FROM g1)"""


@query("q7_bar_gate", with_(BARS["s"], _GATE, body=f"""SELECT symbol, date, CASE WHEN before < 50 THEN {_RULE} WHEN (flag OR extreme) AND {_NEAR} THEN 'CORP_ACTION'
  WHEN (flag OR extreme) AND dev > 0 AND (extreme OR abs((ratio - 1 - mean) / dev) > 5) THEN 'BAD_TICK' ELSE 'OK' END AS verdict FROM g2"""))
def q7(spark, d):
    """The model's flag stands in as a wide high-low spread, which SQL can say too; q6 has the forest's own flags."""
    b = supplier_bars(spark, d)
    return q.bar_gate(b, flagged=(c.high - c.low) / c.close > 0.6).select("symbol", "date", "verdict")


_OLD, _NEW = "date <= DATE '2000-12-31'", "date > DATE '2000-12-31'"


def _split(spark, d):
    b = supplier_bars(spark, d).drop("deliv_pct")
    return b.filter(c.date <= "2000-12-31"), b.filter(c.date > "2000-12-31")


_RATIO = f"ap AS (SELECT symbol, arg_max(close, date) FILTER (WHERE {_OLD}) AS lo, arg_min(close, date) FILTER (WHERE {_NEW}) AS fn FROM bars GROUP BY symbol)"


@query("q8_gate_fallback", with_(BARS["s"], _RATIO, "rt AS (SELECT symbol, fn / lo AS ratio FROM ap WHERE fn IS NOT NULL)", body=f"SELECT symbol, round(ratio, 4) AS ratio, {_RULE} AS decision FROM rt"))
def q8(spark, d):
    return rounded(q.gate_fallback(*_split(spark, d)))


@query("q9_missing_days", with_(BARS["s"], "lb AS (SELECT symbol, max(date) AS d FROM bars GROUP BY symbol), x AS (SELECT DISTINCT CAST(unnest(generate_series(greatest(CAST(d + 1 AS TIMESTAMP), TIMESTAMP '2001-11-01'), TIMESTAMP '2001-12-01', INTERVAL 1 DAY)) AS DATE) AS day FROM lb)",
  body="SELECT day FROM x WHERE dayofweek(day) NOT IN (0, 6)"))
def q9(spark, d):
    return q.missing_days(B.latest_bars(supplier_bars(spark, d)), F.lit(AS_OF).cast("date"), 30)


@query("q10_append_or_reject", with_(BARS["s"], _RATIO, body=f"SELECT b.symbol, date, round(close, 4) AS close FROM bars b JOIN ap USING (symbol) WHERE {_OLD} OR (fn / lo >= 0.8 AND fn / lo <= 2)"))
def q10(spark, d):
    return rounded(q.append_or_reject(*_split(spark, d)).select("symbol", "date", "close"))


_ADJ = """af AS (SELECT symbol, fn / lo AS r FROM ap WHERE fn IS NOT NULL AND lo IS NOT NULL),
ag AS (SELECT symbol, r, CASE WHEN r >= 0.79 THEN 1.0 WHEN abs(r - 0.5) <= 0.05 THEN 0.5 WHEN abs(r - 0.2) <= 0.05 THEN 0.2 WHEN abs(r - 0.1) <= 0.05 THEN 0.1 WHEN abs(r - 1 / 1.5) <= 0.05 THEN 1 / 1.5 WHEN abs(r - 0.8) <= 0.05 THEN 0.8 WHEN abs(r - 1.0 / 3) <= 0.05 THEN 1.0 / 3 WHEN abs(r - 0.25) <= 0.05 THEN 0.25 END AS factor FROM af)"""


@query("q11_back_adjust", with_(BARS["s"], _RATIO, _ADJ, body=f"SELECT b.symbol, date, round(close * CAST(factor AS DOUBLE), 4) AS close, round(volume / CAST(factor AS DOUBLE), 4) AS volume FROM bars b JOIN ag USING (symbol) WHERE {_OLD} AND factor IS NOT NULL"))
def q11(spark, d):
    return rounded(q.back_adjust(*_split(spark, d)).select("symbol", "date", "close", "volume"))


@query("q12_merge_counts", with_(BARS["s"], body="SELECT symbol, count(*) FILTER (WHERE date <= DATE '2000-12-31') AS before, count(*) AS after, count(*) FILTER (WHERE date > DATE '2000-12-31') AS added FROM bars GROUP BY symbol"))
def q12(spark, d):
    b = supplier_bars(spark, d)
    return q.merge_counts(b.filter(c.date <= "2000-12-31"), b.filter(c.date > "2000-06-30"))


@query("q13_needs_refresh", with_(BARS["s"], _COV, body="SELECT symbol, n < 2 OR (e > 50 AND n / e < 0.8) OR (date_diff('day', d1, DATE '2001-12-01') > 7 AND n < 100) AS full_refresh FROM cov"))
def q13(spark, d):
    return q.needs_refresh(q.coverage(supplier_bars(spark, d)), F.lit(AS_OF).cast("date")).select("symbol", "full_refresh")


_REG = "reg AS (SELECT symbol, min(date) AS first_bar, max(date) AS last_bar, count(*) AS rows, CASE WHEN count(*) < 2 THEN 'pending' WHEN date_diff('day', max(date), DATE '2001-12-01') > 60 THEN 'failed' ELSE 'ok' END AS status FROM bars GROUP BY symbol)"


def _reg(spark, d):
    return q.registry(supplier_bars(spark, d), F.lit(AS_OF).cast("date"))


@query("q14_update_order", with_(BARS["s"], _REG, body="SELECT symbol, status, last_bar, rows, CASE status WHEN 'pending' THEN 0 WHEN 'failed' THEN 1 ELSE 2 END AS priority FROM reg WHERE status <> 'ok' OR last_bar < DATE '2001-12-01'"))
def q14(spark, d):
    return q.update_order(_reg(spark, d), F.lit(AS_OF).cast("date")).select("symbol", "status", "last_bar", "rows", "priority")


@query("q15_registry_summary", with_(BARS["s"], _REG, body="SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, CAST(sum(rows) AS BIGINT) AS rows, round(count(*) FILTER (WHERE status = 'ok') * 100.0 / count(*), 1) AS coverage_pct FROM reg"))
def q15(spark, d):
    return q.registry_summary(_reg(spark, d))


@query("a8_registry_status", with_(BARS["s"], _REG, body="SELECT status, count(*) AS n FROM reg GROUP BY status"))
def a8(spark, d):
    return _reg(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("q16_heal", with_(BARS["s"], body="SELECT symbol, date, CASE WHEN date >= DATE '2000-01-01' THEN volume * 2 ELSE volume END AS volume, round(CASE WHEN date >= DATE '2000-01-01' THEN turnover * 3 ELSE turnover END, 2) AS turnover FROM bars"))
def q16(spark, d):
    b = supplier_bars(spark, d)
    f = b.filter(c.date >= "2000-01-01").select("symbol", "date", (c.volume * 2).alias("volume"), (c.turnover * 3).alias("turnover"))
    return q.heal(b, f).select("symbol", "date", "volume", rnd("turnover", 2).alias("turnover"))


@query("q17_indicator_parity")
def q17(spark, d):
    return rounded(q.parity(ind.recursive(ind.sma(supplier_bars(spark, d), (50,)))), 6)


@query("q18_provisional_bar", with_(BARS["s"], "mx AS (SELECT max(date) AS d FROM bars), lc AS (SELECT symbol, arg_max(close, date) AS cl FROM bars GROUP BY symbol)",
  body="SELECT symbol, date, round(close, 4) AS close, volume FROM bars UNION ALL SELECT symbol, DATE '2001-11-02', round(cl, 4), 0 FROM lc WHERE symbol NOT IN (SELECT symbol FROM bars WHERE date = DATE '2001-11-02')"))
def q18(spark, d):
    b = supplier_bars(spark, d)
    quotes = B.latest_bars(b).select("symbol", "close")
    return rounded(B.with_provisional(b, quotes, "2001-11-02").select("symbol", "date", "close", "volume"))


@query("q19_trading_calendar", with_(BARS["s"], "cal AS (SELECT DISTINCT date AS day FROM bars WHERE volume > 60), dd AS (SELECT DISTINCT date AS day FROM bars)",
  body="SELECT day, day IN (SELECT day FROM cal) AS is_trading, (SELECT max(cal.day) FROM cal WHERE cal.day <= dd.day) AS last_trading_day FROM dd"))
def q19(spark, d):
    b = supplier_bars(spark, d)
    days = b.select(F.col("date").alias("day"))
    return q.last_trading_day(days.distinct(), b.filter(c.volume > 60).select(F.col("date").alias("day")).distinct())


