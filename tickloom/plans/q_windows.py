"""Window primitives and technical indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rank, ts
from ..functions.num import c, rnd
from ..operators import indicators as ind
from ..sources import bars as B
from .catalog import query
from .sqltext import BARS, SOFAR, TICKS, W, full, panel, with_
from .sqltext import rnd as rnds
from .tables import rounded, segment_bars, segment_panel, supplier_bars, supplier_panel, table, ticks


@query(
    "w1_lag_diff_pct",
    with_(BARS["s"], body=f"""SELECT symbol, date, round(lag(close) {W}, 4) AS lag1, round(lead(close) {W}, 4) AS lead1,
  round(close - lag(close) {W}, 4) AS diff1, round(close / nullif(lag(close, 5) {W}, 0) - 1, 6) AS pct5 FROM bars"""),
)
def w1(spark, d):
    b = supplier_bars(spark, d)
    return b.select(
        "symbol", "date",
        rnd(ts.lag(c.close), 4).alias("lag1"),
        rnd(F.lead("close").over(ts.by_symbol()), 4).alias("lead1"),
        rnd(ts.diff(c.close), 4).alias("diff1"),
        rnd(ts.pct_change(c.close, 5), 6).alias("pct5"),
    )


@query(
    "w2_rolling_full",
    with_(BARS["s"], body=f"""SELECT symbol, date, round({full('avg','close',20)}, 4) AS mean20, round({full('min','low',20)}, 4) AS min20,
  round({full('max','high',20)}, 4) AS max20, round({full('stddev_samp','close',20)}, 4) AS std20, round({full('sum','volume',20)}, 4) AS sum20 FROM bars"""),
)
def w2(spark, d):
    return rounded(supplier_bars(spark, d).select(
        "symbol", "date",
        ts.mean(c.close, 20).alias("mean20"), ts.lowest(F.col("low"), 20).alias("min20"), ts.highest(F.col("high"), 20).alias("max20"),
        ts.std(c.close, 20).alias("std20"), ts.total(F.col("volume"), 20).alias("sum20"),
    ))


@query(
    "w3_rolling_min_periods",
    with_(BARS["s"], body="""SELECT symbol, date, round(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 4) AS vol_mean20 FROM bars"""),
)
def w3(spark, d):
    return rounded(supplier_bars(spark, d).select("symbol", "date", F.avg("volume").over(ts.back(20)).alias("vol_mean20")))


@query(
    "w4_centred_max",
    with_(BARS["s"], body="""SELECT symbol, date, round(peak, 4) AS peak, coalesce(high = peak, false) AS is_peak FROM (
  SELECT symbol, date, high, CASE WHEN count(high) OVER w = 5 THEN max(high) OVER w END AS peak FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""),
)
def w4(spark, d):
    b = supplier_bars(spark, d).withColumn("peak", ts.centred_max(F.col("high"), 5))
    return b.select("symbol", "date", rnd("peak", 4).alias("peak"), F.coalesce(F.col("high") == F.col("peak"), F.lit(False)).alias("is_peak"))


@query(
    "w5_expanding",
    with_(BARS["s"], body=f"""SELECT symbol, date, round(avg(close) {SOFAR}, 4) AS mean_so_far, round(max(close) {SOFAR}, 4) AS max_so_far,
  round(close / first_value(close) {SOFAR}, 6) AS growth FROM bars"""),
)
def w5(spark, d):
    b = supplier_bars(spark, d).withColumn("_r", F.coalesce(ts.pct_change(c.close), F.lit(0.0)))
    return b.select(
        "symbol", "date", rnd(ts.expanding_mean(c.close), 4).alias("mean_so_far"), rnd(ts.cum_max(c.close), 4).alias("max_so_far"),
        rnd(ts.cum_prod1p(F.col("_r")), 6).alias("growth"),
    )


@query(
    "w6_ffill",
    with_(BARS["s"], body=f"""SELECT symbol, date, round(last_value(CASE WHEN volume > 30 THEN close END IGNORE NULLS) {SOFAR}, 4) AS filled FROM bars"""),
)
def w6(spark, d):
    return supplier_bars(spark, d).select("symbol", "date", rnd(ts.ffill(F.when(F.col("volume") > 30, c.close)), 4).alias("filled"))


@query(
    "w9_streak",
    with_(BARS["s"], f"""x AS (SELECT *, row_number() {W} AS rn, coalesce(close > lag(close) {W}, false) AS up FROM bars)""",
      body=f"""SELECT symbol, date, rn - coalesce(max(CASE WHEN NOT up THEN rn END) {SOFAR}, 0) AS up_streak FROM x"""),
)
def w9(spark, d):
    b = supplier_bars(spark, d).withColumn("_up", c.close > ts.lag(c.close))
    return ts.with_streak(b, F.col("_up"), "up_streak").select("symbol", "date", "up_streak")


@query(
    "w10_tail",
    with_(BARS["s"], body="""SELECT symbol, date, round(close, 4) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30"""),
)
def w10(spark, d):
    return ts.tail(supplier_bars(spark, d), 30).select("symbol", "date", rnd("close", 4).alias("close"))


@query("w11_recursive_smoothing", panel("s", body="SELECT symbol, date, round(ema_20, 4) AS ema_20, round(atr_14, 4) AS wilder_tr FROM panel"))
def w11(spark, d):
    return rounded(ind.recursive(supplier_bars(spark, d), ema=(20,)).select("symbol", "date", "ema_20", F.col("atr_14").alias("wilder_tr")))


@query(
    "w12_linreg",
    with_(BARS["s"], f"x AS (SELECT *, row_number() {W} AS rn FROM bars)",
      body="""SELECT symbol, date, round(CASE WHEN count(close) OVER w = 20 THEN regr_intercept(close, rn) OVER w + regr_slope(close, rn) OVER w * rn END, 4) AS linreg20
  FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)"""),
)
def w12(spark, d):
    return rounded(ts.linreg_end(supplier_bars(spark, d), "close", 20, "linreg20").select("symbol", "date", "linreg20"))


@query(
    "w13_log_return_vol",
    with_(BARS["s"], f"x AS (SELECT *, ln(close / lag(close) {W}) AS lr FROM bars)", body=f"SELECT symbol, date, round({full('stddev_samp','lr',20)}, 6) AS vol20 FROM x"),
)
def w13(spark, d):
    b = supplier_bars(spark, d).withColumn("_lr", ts.log_return(c.close))
    return b.select("symbol", "date", rnd(ts.std(F.col("_lr"), 20), 6).alias("vol20"))


_RESAMPLE = """SELECT '{k}' AS every, symbol, {b} AS bucket, round(arg_min(open, date), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low,
  round(arg_max(close, date), 4) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, bucket"""


@query(
    "w14_resample",
    with_(BARS["s"], body=_RESAMPLE.format(k="week", b="CAST(date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS DATE)") + " UNION ALL "
      + _RESAMPLE.format(k="month", b="last_day(date)")),
)
def w14(spark, d):
    b = supplier_bars(spark, d)
    parts = [B.resample(b, k).select(F.lit(k).alias("every"), "symbol", F.col("date").alias("bucket"), "open", "high", "low", "close", "volume") for k in ("week", "month")]
    return rounded(parts[0].unionByName(parts[1]))


@query(
    "w15_intraday",
    with_(TICKS, body="""SELECT symbol, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '2024-01-01') AS start, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(ts, seq)) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS ticks FROM ticks GROUP BY symbol, start"""),
)
def w15(spark, d):
    return B.intraday_bars(ticks(spark, d), "4 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


_IND = {
    "t2_ema": ("ema_20 ema_50 ema_100 ema_200", "s"),
    "t3_rsi": ("rsi_14", "s"),
    "t4_macd": ("macd macd_signal macd_hist", "s"),
    "t6_atr": ("atr_14", "g"),
    "t7_di": ("plus_di_14 minus_di_14", "g"),
    "t8_adx": ("adx_14", "g"),
}


def _recursive_query(name: str, cols: str, kind: str) -> None:
    src = {"s": supplier_bars, "g": segment_bars}[kind]

    @query(name, panel(kind, body=f"SELECT symbol, date, {rnds(cols)} FROM panel"))
    def run(spark, d):
        return rounded(ind.recursive(src(spark, d)).select("symbol", "date", *cols.split()))


for _n, (_c, _k) in _IND.items():
    _recursive_query(_n, _c, _k)


def _win(cols: str, kind: str = "s") -> str:
    return panel(kind, body=f"SELECT symbol, date, {rnds(cols)} FROM panel")


@query("t1_sma", _win("sma_20 sma_50 sma_100 sma_150 sma_200"))
def t1(spark, d):
    return rounded(ind.sma(supplier_bars(spark, d)).select("symbol", "date", *[f"sma_{n}" for n in ind.SMA_LENGTHS]))


@query("t5_bollinger", _win("bb_upper bb_middle bb_lower"))
def t5(spark, d):
    return rounded(ind.bollinger(supplier_bars(spark, d)).select("symbol", "date", "bb_upper", "bb_middle", "bb_lower"))


@query("t9_cci", _win("cci_14", "g"))
def t9(spark, d):
    return rounded(ind.cci(segment_bars(spark, d)).select("symbol", "date", "cci_14"))


@query("t10_extremes", _win("low_20 low_126 low_200 high_55 high_252 low_252"))
def t10(spark, d):
    return rounded(ind.extremes(supplier_bars(spark, d)).select("symbol", "date", "low_20", "low_126", "low_200", "high_55", "high_252", "low_252"))


for _n, _c in (("t14_z_score", "z_score"), ("t15_vol_spike", "vol_spike"), ("t16_change_pct", "change_pct")):

    def _mk(name: str, col: str) -> None:
        @query(name, _win(col))
        def run(spark, d):
            return rounded(ind.activity(supplier_bars(spark, d)).select("symbol", "date", col))

    _mk(_n, _c)


_DIV = """last20 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS fe FROM panel),
l20 AS (SELECT *, 20 - fe AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM last20 WHERE fe <= 20),
ext AS (SELECT symbol, max(n) AS n, arg_min(pos, row(close, pos)) AS pmin, arg_min(pos, row(-close, pos)) AS pmax FROM l20 GROUP BY symbol),
prv AS (SELECT l.symbol, arg_min(l.pos, row(l.close, l.pos)) FILTER (WHERE l.pos < e.pmin) AS qmin, arg_min(l.pos, row(-l.close, l.pos)) FILTER (WHERE l.pos < e.pmax) AS qmax
  FROM l20 l JOIN ext e USING (symbol) GROUP BY l.symbol),
dvg AS (SELECT e.symbol, e.n, e.pmin, e.pmax, a.close AS c_min, b.close AS c_qmin, x.close AS c_max, y.close AS c_qmax, a.rsi_14 AS r_min, b.rsi_14 AS r_qmin, x.rsi_14 AS r_max, y.rsi_14 AS r_qmax,
  a.macd_hist AS m_min, b.macd_hist AS m_qmin, x.macd_hist AS m_max, y.macd_hist AS m_qmax
  FROM ext e JOIN prv p USING (symbol) LEFT JOIN l20 a ON a.symbol = e.symbol AND a.pos = e.pmin LEFT JOIN l20 b ON b.symbol = e.symbol AND b.pos = p.qmin
  LEFT JOIN l20 x ON x.symbol = e.symbol AND x.pos = e.pmax LEFT JOIN l20 y ON y.symbol = e.symbol AND y.pos = p.qmax),
divergences AS (SELECT symbol, CASE WHEN n = 20 AND pmax > 10 AND c_max > c_qmax AND r_max < r_qmax THEN 'Bearish' WHEN n = 20 AND pmin > 10 AND c_min < c_qmin AND r_min > r_qmin THEN 'Bullish' ELSE 'None' END AS rsi_divergence,
  CASE WHEN n = 20 AND pmax > 10 AND c_max > c_qmax AND m_max < m_qmax THEN 'Bearish' WHEN n = 20 AND pmin > 10 AND c_min < c_qmin AND m_min > m_qmin THEN 'Bullish' ELSE 'None' END AS macd_divergence FROM dvg)"""


@query("t11_divergence", panel("s", _DIV, body="SELECT symbol, rsi_divergence, macd_divergence FROM divergences"))
def t11(spark, d):
    return ind.divergence(ind.recursive(supplier_bars(spark, d))).select("symbol", "rsi_divergence", "macd_divergence")


SCORE = """(CASE WHEN close > ema_20 THEN 5 ELSE 0 END + CASE WHEN close > sma_50 THEN 10 ELSE 0 END + CASE WHEN close > sma_200 THEN 10 ELSE 0 END
 + CASE WHEN ema_20 > sma_50 THEN 5 ELSE 0 END + CASE WHEN sma_50 > sma_200 THEN 5 ELSE 0 END
 + CASE WHEN rsi_14 BETWEEN 50 AND 70 THEN 25 WHEN rsi_14 BETWEEN 40 AND 50 THEN 15 WHEN rsi_14 >= 30 AND rsi_14 < 40 THEN 5 WHEN rsi_14 > 70 THEN 10 ELSE 0 END
 + CASE WHEN macd > macd_signal THEN 20 ELSE 0 END
 + CASE WHEN bb_upper IS NULL THEN 0 WHEN close BETWEEN bb_middle AND bb_upper THEN 10 WHEN close BETWEEN bb_lower AND bb_middle THEN 5 WHEN close > bb_upper THEN 8 ELSE 0 END
 + CASE WHEN adx_14 IS NULL THEN 0 WHEN adx_14 > 25 THEN CASE WHEN close > sma_50 THEN 10 ELSE 0 END ELSE 5 END)"""
RATING = "CASE WHEN tech_score >= 80 THEN 'STRONG BUY' WHEN tech_score >= 60 THEN 'BUY' WHEN tech_score >= 40 THEN 'NEUTRAL' WHEN tech_score >= 20 THEN 'SELL' ELSE 'STRONG SELL' END"


@query("t12_tech_score", panel("s", f"sc AS (SELECT *, {SCORE} AS tech_score FROM panel)", body=f"SELECT symbol, date, tech_score, {RATING} AS tech_rating FROM sc"))
def t12(spark, d):
    return ind.tech_score(supplier_panel(spark, d)).select("symbol", "date", "tech_score", "tech_rating")


@query("w7_percent_rank", with_(BARS["s"], body="""SELECT symbol, date, round((rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date) * 100, 4) AS pct FROM bars"""))
def w7(spark, d):
    b = supplier_bars(spark, d)
    return rounded(rank.percent_rank_avg(b.select("symbol", "date", "close"), "close", "pct", within=["date"]).select("symbol", "date", "pct"))


@query("w8_min_rank", with_(BARS["s"], body="SELECT symbol, date, rank() OVER (ORDER BY volume DESC) AS rank FROM bars"))
def w8(spark, d):
    return rank.min_rank(supplier_bars(spark, d).select("symbol", "date", "volume"), "volume", "rank").select("symbol", "date", "rank")


@query("t13_latest_labels", panel("s", body="""SELECT symbol, CASE WHEN ema_20 IS NULL THEN 'N/A' WHEN close > ema_20 THEN 'ABOVE' ELSE 'BELOW' END AS vs_ema_20, CASE WHEN sma_50 IS NULL THEN 'N/A' WHEN close > sma_50 THEN 'ABOVE' ELSE 'BELOW' END AS vs_sma_50,
  CASE WHEN sma_200 IS NULL THEN 'N/A' WHEN close > sma_200 THEN 'ABOVE' ELSE 'BELOW' END AS vs_sma_200, CASE WHEN rsi_14 IS NULL THEN 'N/A' WHEN rsi_14 >= 70 THEN 'OVERBOUGHT' WHEN rsi_14 <= 30 THEN 'OVERSOLD' WHEN rsi_14 >= 50 THEN 'BULLISH' WHEN rsi_14 >= 40 THEN 'NEUTRAL-BULLISH' ELSE 'BEARISH' END AS rsi_zone,
  CASE WHEN macd_hist IS NULL THEN 'N/A' WHEN macd > macd_signal THEN 'BULLISH' ELSE 'BEARISH' END AS macd_state, CASE WHEN bb_upper > bb_lower THEN round((close - bb_lower) / (bb_upper - bb_lower) * 100, 1) END AS bb_position_pct,
  CASE WHEN adx_14 IS NULL THEN 'N/A' WHEN adx_14 > 25 THEN 'STRONG' ELSE 'WEAK' END AS adx_state, round(atr_14 / close * 100, 2) AS atr_pct, CASE WHEN cci_14 IS NULL THEN 'N/A' WHEN cci_14 >= 100 THEN 'OVERBOUGHT' WHEN cci_14 <= -100 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS cci_zone FROM panel WHERE is_last"""))
def t13(spark, d):
    return ind.latest_labels(ind.latest_indicators(supplier_bars(spark, d)))
