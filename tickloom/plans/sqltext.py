"""Shared SQL fragments (CTEs) for the oracle side.  They state the same tables and
definitions in plain SQL: recursive CTEs for smoothing, window frames for the rest."""

from __future__ import annotations

_PX = """px AS (SELECT {sym} AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
    l_quantity AS qty, l_extendedprice AS amount, l_discount AS disc, l_orderkey, l_linenumber, l_partkey FROM {src}),
bars AS (SELECT symbol, date,
    arg_min(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS close,
    sum(qty) AS volume, sum(amount) AS turnover, avg(disc * 100.0 * 5) AS deliv_pct
  FROM px GROUP BY symbol, date)"""

BARS = {
    "s": _PX.format(sym="CAST(l_suppkey AS VARCHAR)", src="lineitem"),
    "g": _PX.format(sym="l_returnflag || l_linestatus", src="lineitem"),
    "n": _PX.format(
        sym="n_name",
        src="lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    ),
}

MASTER = """master AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, s_acctbal AS acctbal,
    n_name AS nation, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

TICKS = """ticks AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, event_id AS seq, value AS price, event_type, props
  FROM events)"""


def full(agg: str, col: str, n: int) -> str:
    """Window aggregate gated on n non-null values."""
    w = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} = {n} THEN {agg}({col}) {w} END"


W = "OVER (PARTITION BY symbol ORDER BY date)"
SOFAR = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c for c in ctes if c) + "\n" + body


# windows of the indicator panel
WIN = f"""win0 AS (SELECT *, row_number() {W} - 1 AS bn, lag(close) {W} AS prev_close, lag(high) {W} AS ph, lag(low) {W} AS pl,
    (high + low + close) / 3.0 AS tp, close / nullif(lag(close) {W}, 0) - 1 AS ret FROM bars),
win AS (SELECT *,
    {", ".join(f"{full('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 100, 150, 200))},
    {full("stddev_pop", "close", 20)} AS sdp, {full("min", "low", 20)} AS low_20, {full("min", "low", 126)} AS low_126,
    {full("min", "low", 200)} AS low_200, {full("max", "high", 55)} AS high_55, {full("max", "high", 252)} AS high_252,
    {full("min", "low", 252)} AS low_252, {full("avg", "ret", 20)} AS rmu, {full("stddev_samp", "ret", 20)} AS rsd,
    {full("avg", "volume", 20)} AS vavg,
    {full("avg", "tp", 14)} AS tpm, {full("list", "tp", 14)} AS tpl
  FROM win0)"""

# one step per bar, all symbols at once
REC = """inp AS (SELECT symbol, bn, close, coalesce(greatest(close - prev_close, 0), 0) AS g, coalesce(greatest(prev_close - close, 0), 0) AS d,
    CASE WHEN bn > 0 THEN greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS tr,
    CASE WHEN high - ph > 0 AND high - ph > pl - low THEN high - ph ELSE 0 END AS pdm,
    CASE WHEN pl - low > 0 AND pl - low > high - ph THEN pl - low ELSE 0 END AS mdm FROM win0),
seeds AS (SELECT *,
    avg(close) OVER w12 AS s12, avg(close) OVER w20 AS s20, avg(close) OVER w26 AS s26, avg(close) OVER w50 AS s50,
    avg(close) OVER w100 AS s100, avg(close) OVER w200 AS s200,
    avg(g) OVER w14 AS mg, avg(d) OVER w14 AS md, avg(tr) OVER w14 AS mtr,
    sum(pdm) OVER w13 AS tpdm, sum(mdm) OVER w13 AS tmdm, sum(tr) OVER w13 AS ttr
  FROM inp WINDOW w12 AS (PARTITION BY symbol ORDER BY bn ROWS 11 PRECEDING), w13 AS (PARTITION BY symbol ORDER BY bn ROWS 12 PRECEDING),
    w14 AS (PARTITION BY symbol ORDER BY bn ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY bn ROWS 19 PRECEDING),
    w26 AS (PARTITION BY symbol ORDER BY bn ROWS 25 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY bn ROWS 49 PRECEDING),
    w100 AS (PARTITION BY symbol ORDER BY bn ROWS 99 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY bn ROWS 199 PRECEDING)),
r1 AS (
  SELECT symbol, bn, CAST(NULL AS DOUBLE) AS e20, CAST(NULL AS DOUBLE) AS e50, CAST(NULL AS DOUBLE) AS e100, CAST(NULL AS DOUBLE) AS e200,
    CAST(NULL AS DOUBLE) AS fast, CAST(NULL AS DOUBLE) AS slow, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS ad, CAST(NULL AS DOUBLE) AS atr,
    CAST(NULL AS DOUBLE) AS zp, CAST(NULL AS DOUBLE) AS zm, CAST(NULL AS DOUBLE) AS zt
  FROM seeds WHERE bn = 0
  UNION ALL
  SELECT s.symbol, s.bn,
    CASE WHEN s.bn = 19 THEN s.s20 ELSE r.e20 + 2.0/21 * (s.close - r.e20) END,
    CASE WHEN s.bn = 49 THEN s.s50 ELSE r.e50 + 2.0/51 * (s.close - r.e50) END,
    CASE WHEN s.bn = 99 THEN s.s100 ELSE r.e100 + 2.0/101 * (s.close - r.e100) END,
    CASE WHEN s.bn = 199 THEN s.s200 ELSE r.e200 + 2.0/201 * (s.close - r.e200) END,
    CASE WHEN s.bn = 25 THEN s.s12 ELSE r.fast + 2.0/13 * (s.close - r.fast) END,
    CASE WHEN s.bn = 25 THEN s.s26 ELSE r.slow + 2.0/27 * (s.close - r.slow) END,
    CASE WHEN s.bn = 14 THEN s.mg ELSE (r.ag * 13 + s.g) / 14 END,
    CASE WHEN s.bn = 14 THEN s.md ELSE (r.ad * 13 + s.d) / 14 END,
    CASE WHEN s.bn = 14 THEN s.mtr ELSE (r.atr * 13 + s.tr) / 14 END,
    CASE WHEN s.bn = 13 THEN s.tpdm ELSE r.zp - r.zp / 14 + s.pdm END,
    CASE WHEN s.bn = 13 THEN s.tmdm ELSE r.zm - r.zm / 14 + s.mdm END,
    CASE WHEN s.bn = 13 THEN s.ttr ELSE r.zt - r.zt / 14 + s.tr END
  FROM r1 r JOIN seeds s ON s.symbol = r.symbol AND s.bn = r.bn + 1),
s1 AS (SELECT *, CASE WHEN bn >= 14 THEN CASE WHEN zt <> 0 THEN 100 * zp / zt ELSE 0 END END AS pdi,
    CASE WHEN bn >= 14 THEN CASE WHEN zt <> 0 THEN 100 * zm / zt ELSE 0 END END AS mdi, fast - slow AS mac FROM r1),
s2 AS (SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM s1),
s3 AS (SELECT *, avg(mac) OVER (PARTITION BY symbol ORDER BY bn ROWS 8 PRECEDING) AS ms,
    avg(coalesce(dx, 0)) OVER (PARTITION BY symbol ORDER BY bn ROWS 13 PRECEDING) AS xs FROM s2),
r2 AS (
  SELECT symbol, bn, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS adx FROM s3 WHERE bn = 0
  UNION ALL
  SELECT s.symbol, s.bn, CASE WHEN s.bn = 33 THEN s.ms ELSE r.sig + 2.0/10 * (s.mac - r.sig) END,
    CASE WHEN s.bn = 27 THEN s.xs WHEN s.dx IS NULL THEN r.adx ELSE (r.adx * 13 + s.dx) / 14 END
  FROM r2 r JOIN s3 s ON s.symbol = r.symbol AND s.bn = r.bn + 1)"""

PANEL = """panel AS (SELECT w.symbol, w.date, w.open, w.high, w.low, w.close, w.volume, w.turnover, w.deliv_pct, w.bn, w.prev_close,
    sma_20, sma_50, sma_100, sma_150, sma_200, low_20, low_126, low_200, high_55, high_252, low_252,
    sma_20 AS bb_middle, sma_20 + 2 * sdp AS bb_upper, sma_20 - 2 * sdp AS bb_lower,
    coalesce((ret - rmu) / nullif(rsd, 0), 0) AS z_score, CASE WHEN vavg > 0 THEN volume / vavg ELSE 0 END AS vol_spike,
    CASE WHEN w.prev_close > 0 THEN (w.close - w.prev_close) * 100.0 / w.prev_close ELSE 0 END AS change_pct,
    CASE WHEN tpm IS NOT NULL THEN CASE WHEN tp <> tpm AND list_sum(list_transform(tpl, lambda x: abs(x - tpm))) <> 0
      THEN (tp - tpm) / (0.015 * (list_sum(list_transform(tpl, lambda x: abs(x - tpm))) / 14)) ELSE 0 END END AS cci_14,
    e20 AS ema_20, e50 AS ema_50, e100 AS ema_100, e200 AS ema_200,
    CASE WHEN w.bn >= 14 THEN CASE WHEN ag + ad <> 0 THEN 100 * ag / (ag + ad) ELSE 0 END END AS rsi_14,
    atr AS atr_14, pdi AS plus_di_14, mdi AS minus_di_14, adx AS adx_14,
    CASE WHEN w.bn >= 33 THEN mac END AS macd, sig AS macd_signal, mac - sig AS macd_hist,
    lag(high_55) OVER (PARTITION BY w.symbol ORDER BY w.date) AS prev_high_55, lag(sma_100) OVER (PARTITION BY w.symbol ORDER BY w.date) AS prev_sma_100,
    lead(w.date) OVER (PARTITION BY w.symbol ORDER BY w.date) IS NULL AS is_last
  FROM win w JOIN s1 USING (symbol, bn) JOIN r2 USING (symbol, bn))"""


def panel(kind: str, *more: str, body: str) -> str:
    """SQL over the full indicator panel of the given bars."""
    return with_(BARS[kind], WIN, REC, PANEL, *more, body=body, recursive=True)


def rnd(cols: str, digits: int = 4) -> str:
    """'a b c' -> rounded select items; a name followed by ! is passed through."""
    return ", ".join(c[:-1] if c.endswith("!") else f"round({c}, {digits}) AS {c}" for c in cols.split())
