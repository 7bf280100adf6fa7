"""Lists, reports, aggregations and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, rnd, truth
from ..functions.rolling import rolling
from ..operators import consensus as con
from ..operators import indicators as ind
from ..operators import pairs as pr
from ..operators import reports as rp
from ..operators import strategies as st
from ..operators import trend as tr
from ..operators.snapshot import with_universe
from ..session import written
from ..sources import bars as B
from .catalog import query
from .q_trend import A_MAS, ACT, BOTTOM, CAR, D200, SL_MAS, VOTES, WEEKLY, in_list, snap_sql, snapshot, status_sql
from .q_windows import SCORE
from .sqltext import BARS, MASTER, W, panel, with_
from .tables import index_close, rounded, segment_bars, supplier_bars, supplier_panel, suppliers, table

# classified bars: every bar with trend, swing and CAR labels; the distance cap is widened for this data
_LISTS = f"""lists AS (SELECT d2.symbol, d2.date, d2.close, d2.volume, d2.turnover, d2.prev_close, d2.diff_200, d2.close * d2.volume AS traded_value, {status_sql(A_MAS, 100000).replace('diff_200', 'd2.diff_200').replace('close', 'd2.close').replace('sma_', 'd2.sma_')} AS trend_status,
  {status_sql(SL_MAS, 100000, ' (SL)').replace('diff_200', 'd2.diff_200').replace('close', 'd2.close').replace('sma_', 'd2.sma_')} AS trend_status_sl, car_rating, bottom_out_status, swing_advice, bo.high_20d AS gtt_trigger
  FROM d2 JOIN car USING (symbol) JOIN bo ON bo.symbol = d2.symbol AND bo.date = d2.date)"""


CAR3 = CAR.replace(">= 8 THEN", ">= 3 THEN")  # looser, so that the lists are not empty on this data


def list_sql(body: str) -> str:
    return panel("s", D200, CAR3, BOTTOM, _LISTS, body=body)


def lists(spark, d):
    b = supplier_bars(spark, d)
    p = rolling(b, {**{f"sma_{n}": ("mean", "close", n) for n in ind.SMA_LENGTHS}, "high_20d": ("max", "high", 20), "low_20d": ("min", "low", 20)})
    p = tr.bottom_out_columns(p.withColumn("prev_close", ts.lag(c.close)))
    p = tr.trend_status_sl(tr.trend_status(p, 100000.0), 100000.0).withColumn("traded_value", c.close * c.volume)
    return p.join(tr.car_rating(b, need=3), "symbol")


_L = "symbol, date, round(close, 4) AS close, round(traded_value, 2) AS traded_value"


def _cols(df):
    return df.select("symbol", "date", rnd("close").alias("close"), rnd("traded_value", 2).alias("traded_value"))


@query("p1_final_list", list_sql(f"SELECT {_L} FROM lists WHERE trend_status = 'In Bull Run' AND car_rating = 'Buy/Average Out'"))
def p1(spark, d):
    return _cols(rp.final_list(lists(spark, d)))


@query("p2_swing_list", list_sql(f"SELECT {_L} FROM lists WHERE bottom_out_status IN ('Start GTT', 'Start GTT (Basic)')"))
def p2(spark, d):
    return _cols(rp.swing_list(lists(spark, d)))


@query("p3_super_list", list_sql(f"SELECT {_L} FROM lists WHERE trend_status = 'In Bull Run' AND car_rating = 'Buy/Average Out' AND bottom_out_status = 'Start GTT'"))
def p3(spark, d):
    return _cols(rp.super_list(lists(spark, d)))


@query("p4_bull_sl_list", list_sql(f"SELECT {_L} FROM lists WHERE trend_status_sl = 'In Bull Run (SL)' AND car_rating = 'Buy/Average Out'"))
def p4(spark, d):
    return _cols(rp.bull_sl_list(lists(spark, d)))


@query("p5_swing_target", list_sql(f"SELECT {_L}, round(gtt_trigger * 1.2, 4) AS gtt_target_20pct FROM lists WHERE bottom_out_status IN ('Start GTT', 'Start GTT (Basic)')"))
def p5(spark, d):
    return rp.swing_target(lists(spark, d)).select("symbol", "date", rnd("close").alias("close"), rnd("traded_value", 2).alias("traded_value"), rnd("gtt_target_20pct").alias("gtt_target_20pct"))


_ROWS = "rows_ AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT symbol, date, close, close * volume AS traded_value, {i} AS ord, '{v}' AS strategy, {v}_action AS action, "
    + (f"{v}_target" if v != "dma20" else "CAST(NULL AS DOUBLE)") + " AS target, "
    + (f"{v}_sl" if v not in ("rsi_ladder", "dma20", "dma_nosl") else "CAST(NULL AS DOUBLE)") + " AS stop_loss, " + ("dma20_diff" if v == "dma20" else "CAST(NULL AS DOUBLE)")
    + f" AS diff_pct FROM act WHERE {v}_action <> '{rp.IDLE[v]}'"
    for i, v in enumerate(st.BAR_WISE)
) + "))"


def _strategy_rows(spark, d):
    p = supplier_panel(spark, d).withColumn("traded_value", c.close * c.volume)
    return rp.strategy_rows(st.bar_strategies(p))


@query("p6_strategy_report", panel("s", ACT, _ROWS, body="SELECT symbol, date, strategy, action, round(target, 4) AS target, round(stop_loss, 4) AS stop_loss, round(traded_value, 2) AS traded_value FROM rows_"))
def p6(spark, d):
    return _strategy_rows(spark, d).select("symbol", "date", "strategy", "action", rnd("target").alias("target"), rnd("stop_loss").alias("stop_loss"), rnd("traded_value", 2).alias("traded_value"))


@query("p7_dma_variants", list_sql("""SELECT 'A' AS variant, symbol AS code, date, round(turnover, 2) AS turnover, round(prev_close, 4) AS previous_close, round(close, 4) AS cmp, round(diff_200, 4) AS diff_200_dma FROM lists WHERE trend_status = 'In Bull Run' AND car_rating = 'Buy/Average Out'
 UNION ALL SELECT 'B', symbol, date, round(turnover, 2), round(prev_close, 4), round(close, 4), round(diff_200, 4) FROM lists WHERE trend_status_sl = 'In Bull Run (SL)' AND car_rating = 'Buy/Average Out'"""))
def p7(spark, d):
    # one pass: a row is offered to each variant that it is in
    offers = F.array(*[F.struct(F.lit(v).alias("variant"), truth(cond).alias("_in")) for v, cond in (("A", rp.in_final()), ("B", rp.in_bull_sl()))])
    t = lists(spark, d).select("*", F.inline(F.filter(offers, lambda x: x["_in"])))
    return t.select(
        "variant", F.col("symbol").alias("code"), "date", rnd("turnover", 2).alias("turnover"), rnd("prev_close").alias("previous_close"), rnd("close").alias("cmp"), rnd("diff_200").alias("diff_200_dma")
    ).orderBy("variant", "cmp")


_CAP = """cap AS (SELECT *, acctbal > 6000 AS is_large, acctbal > 2000 AND acctbal <= 6000 AS is_mid, acctbal > -500 AND acctbal <= 2000 AS is_small,
  CASE WHEN acctbal > 6000 THEN 'Large' WHEN acctbal > 2000 THEN 'Mid' WHEN acctbal > -500 THEN 'Small' ELSE 'Other' END AS cap_category FROM master)"""


def capped(spark, d):
    m = suppliers(spark, d)
    m = m.withColumns({"is_large": c.acctbal > 6000, "is_mid": (c.acctbal > 2000) & (c.acctbal <= 6000), "is_small": (c.acctbal > -500) & (c.acctbal <= 2000)})
    return m.withColumn("cap_category", rp.cap_bucket([c.is_large], [c.is_mid], [c.is_small]))


@query("p8_master_filter", with_(MASTER, _CAP, body="SELECT symbol FROM cap WHERE cap_category = 'Large' AND coalesce(is_large, false)"))
def p8(spark, d):
    return rp.master_filter(capped(spark, d), category="Large", index="is_large")


@query("p9_dashboard_filter", snap_sql(MASTER, VOTES, body=f"SELECT v.symbol, sector, consensus_score, dma20_action FROM votes v JOIN master USING (symbol) WHERE dma20_action IN {in_list(con.BUY_LABELS)} AND consensus_score >= 1 AND sector IN ('ASIA', 'EUROPE', 'AMERICA')"))
def p9(spark, d):
    t = con.vote(snapshot(spark, d)).join(suppliers(spark, d).select("symbol", "sector"), "symbol").filter(c.sector.isin("ASIA", "EUROPE", "AMERICA"))
    return rp.signal_filter(t, "dma20", 1).select("symbol", "sector", "consensus_score", "dma20_action")


@query("p10_cap_bucket", with_(MASTER, _CAP, body="SELECT symbol, cap_category FROM cap"))
def p10(spark, d):
    return capped(spark, d).select("symbol", "cap_category")


_ORD = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 6 WHEN 'P' THEN 5 END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, CAST(o_orderkey % 5 AS INTEGER) AS type,
  CASE WHEN o_orderkey % 6 = 0 THEN 'CNC' WHEN o_orderkey % 6 = 1 THEN 'INTRADAY' WHEN o_orderkey % 6 = 2 THEN 'MARGIN' WHEN o_orderkey % 6 = 3 THEN 'CO' WHEN o_orderkey % 6 = 4 THEN 'BO' ELSE 'XX' END AS product FROM orders"""


def broker_orders(spark, d):
    """Orders with broker codes: status from F/O/P, side, type and product from the key."""
    o = table(spark, d, "orders")
    k = c.o_orderkey
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(c.o_orderstatus == "F", 2).when(c.o_orderstatus == "O", 6).when(c.o_orderstatus == "P", 5).alias("status"),
        F.when(k % 2 == 0, 1).otherwise(-1).alias("side"),
        (k % 5).cast("int").alias("type"),
        F.element_at(F.array(*[F.lit(x) for x in ("CNC", "INTRADAY", "MARGIN", "CO", "BO", "XX")]), (k % 6 + 1).cast("int")).alias("product"),
    )


@query("p11_enum_decode", f"""SELECT o_orderkey, CASE status WHEN 2 THEN 'complete' WHEN 5 THEN 'rejected' WHEN 4 THEN 'trigger pending' WHEN 6 THEN 'open' WHEN 1 THEN 'cancelled' ELSE 'unknown' END AS order_status, CASE side WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'unknown' END AS action,
  CASE type WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'MARKET' WHEN 3 THEN 'SL-M' WHEN 4 THEN 'SL' ELSE 'unknown' END AS pricetype, CASE product WHEN 'CNC' THEN 'CNC' WHEN 'INTRADAY' THEN 'MIS' WHEN 'MARGIN' THEN 'NRML' WHEN 'CO' THEN 'CO' WHEN 'BO' THEN 'BO' ELSE 'unknown' END AS product FROM ({_ORD})""")
def p11(spark, d):
    from ..operators.broker import decode_orders

    return decode_orders(broker_orders(spark, d)).select("o_orderkey", "order_status", "action", "pricetype", "product")


@query("p12_mood_band", "SELECT event_id, CASE WHEN value >= 70 THEN 'Extreme Greed' WHEN value >= 50 THEN 'Greed' WHEN value >= 30 THEN 'Fear' ELSE 'Extreme Fear' END AS mood FROM events")
def p12(spark, d):
    return table(spark, d, "events").select("event_id", rp.mood_band(c.value).alias("mood"))


# ---- aggregations -------------------------------------------------------------

_SIG = "sig AS (SELECT symbol, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS action, value / 500.0 AS conviction FROM ticks)"
_TK = "ticks AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, event_id, value, event_type FROM events)"


def _signals(spark, d):
    e = table(spark, d, "events")
    act = F.when(c.event_type == "purchase", 1).when(c.event_type == "error", -1).otherwise(0)
    return con.signal(e.withColumn("symbol", F.col("user_id").cast("string")), "event", act, c.value / 500.0, c.ts, {"type": c.event_type, "id": c.event_id})


@query("a1_consensus_mean", with_(_TK, _SIG, body="SELECT symbol, round(avg(action * conviction), 6) AS score FROM sig GROUP BY symbol"))
def a1(spark, d):
    return rounded(con.consensus_mean(_signals(spark, d)), 6)


@query("a2_recommendation", with_(_TK, _SIG, body="SELECT symbol, CASE WHEN s > 0.3 THEN 'STRONG_BUY' WHEN s > 0.1 THEN 'BUY' WHEN s < -0.3 THEN 'STRONG_SELL' WHEN s < -0.1 THEN 'SELL' ELSE 'HOLD' END AS recommendation FROM (SELECT symbol, 20 * round(avg(action * conviction), 6) AS s FROM sig GROUP BY symbol)"))
def a2(spark, d):
    m = con.consensus_mean(_signals(spark, d))
    return m.select("symbol", con.recommendation(20 * rnd("score", 6)).alias("recommendation"))


@query("a3_grouped_view", panel("s", ACT, _ROWS, f"sc AS (SELECT *, {SCORE} AS tech_score FROM panel)", """gr AS (SELECT symbol, date, round(arg_min(traded_value, ord), 2) AS traded_value, round(arg_min(close, ord), 4) AS close, round(arg_min(diff_pct, ord), 4) AS diff_pct, string_agg(strategy, ' | ' ORDER BY ord) AS strategies, string_agg(action, ' | ' ORDER BY ord) AS actions,
  coalesce(string_agg(CASE WHEN target IS NOT NULL THEN printf('%.2f', round(target, 2)) END, ' | ' ORDER BY ord), '') AS targets, coalesce(string_agg(CASE WHEN stop_loss IS NOT NULL THEN printf('%.2f', round(stop_loss, 2)) END, ' | ' ORDER BY ord), '') AS stop_losses FROM rows_ GROUP BY symbol, date)""",
  body="SELECT gr.*, round(change_pct, 4) AS change_pct, round(z_score, 4) AS z_score, round(vol_spike, 4) AS vol_spike, round(rsi_14, 4) AS rsi_14, tech_score FROM gr JOIN sc USING (symbol, date)"))
def a3(spark, d):
    p = ind.tech_score(supplier_panel(spark, d)).withColumn("traded_value", c.close * c.volume)
    g = rp.grouped_bars(st.bar_strategies(p))
    return g.withColumns({"traded_value": rnd("traded_value", 2), **{x: rnd(x) for x in ("close", "diff_pct", "change_pct", "z_score", "vol_spike", "rsi_14")}}).orderBy(F.desc("traded_value"))


@query("a4_buy_counts", snap_sql(VOTES, body=" UNION ALL ".join(f"SELECT '{v}' AS strategy, count(*) FILTER (WHERE {v}_action IN {in_list(con.BUY_LABELS)}) AS buys FROM votes" for v in st.VOTERS)))
def a4(spark, d):
    return rp.buy_counts(snapshot(spark, d), st.VOTERS)


@query("a5_kpis", snap_sql(VOTES, body=f"""SELECT count(*) FILTER (WHERE trend_status = 'In Bull Run') AS bull_run, count(*) FILTER (WHERE consensus_score >= 4) AS high_conviction, count(*) FILTER (WHERE bottom_out_status IN ('Start GTT', 'Start GTT (Basic)')) AS gtt_setups,
  CAST({" + ".join(f"count(*) FILTER (WHERE {v}_action IN {in_list(con.BUY_LABELS)})" for v in ("vcp", "squeeze", "supertrend", "knn"))} AS BIGINT) AS late_strategy_hits FROM votes"""))
def a5(spark, d):
    return rp.kpis(con.vote(snapshot(spark, d)))


@query("a6_score_distribution", snap_sql(VOTES, body="SELECT consensus_score, count(*) AS n FROM votes GROUP BY consensus_score"))
def a6(spark, d):
    return rp.distribution(con.vote(snapshot(spark, d)), "consensus_score")


@query("a7_leaderboard", snap_sql(VOTES, body="SELECT symbol, consensus_score FROM votes WHERE consensus_score >= 1 ORDER BY consensus_score DESC, symbol LIMIT 20"))
def a7(spark, d):
    return rp.leaderboard(con.vote(snapshot(spark, d)).select("symbol", "consensus_score"), 1, 20)


@query("a9_order_statistics", f"SELECT count(*) FILTER (WHERE side = 1) AS total_buy_orders, count(*) FILTER (WHERE side = -1) AS total_sell_orders, count(*) FILTER (WHERE status = 2) AS total_completed_orders, count(*) FILTER (WHERE status = 6) AS total_open_orders, count(*) FILTER (WHERE status = 5) AS total_rejected_orders FROM ({_ORD})")
def a9(spark, d):
    return rp.order_statistics(broker_orders(spark, d))


_HOLD = """h AS (SELECT o_custkey, l_partkey, sum(l_quantity) AS quantity, round(sum(l_extendedprice) / sum(l_quantity), 6) AS cost_price, max(p_retailprice) AS ltp FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def holdings(spark, d):
    """Holdings: customer x part, cost from the trades, last price from the part list."""
    l, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    j = l.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").join(o.select("o_orderkey", "o_custkey"), l.l_orderkey == o.o_orderkey)
    h = j.groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), rnd(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("cost_price"))
    h = h.join(p.select("p_partkey", F.col("p_retailprice").alias("ltp")), h.l_partkey == p.p_partkey).drop("p_partkey")
    return h.withColumn("pl", (c.ltp - c.cost_price) * c.quantity)


@query("a10_holdings_statistics", with_(_HOLD, body="SELECT round(sum(ltp * quantity), 2) AS totalholdingvalue, round(sum(cost_price * quantity), 2) AS totalinvvalue, round(sum((ltp - cost_price) * quantity), 2) AS totalprofitandloss, round(sum((ltp - cost_price) * quantity) / sum(cost_price * quantity) * 100, 2) AS totalpnlpercentage FROM h"))
def a10(spark, d):
    return rounded(rp.holdings_statistics(holdings(spark, d)), 2)


@query("a11_holding_pnl", with_(_HOLD, body="SELECT o_custkey, l_partkey, round((ltp - cost_price) / cost_price * 100, 4) AS pnlpercent FROM h"))
def a11(spark, d):
    return rounded(rp.holding_pnl(holdings(spark, d)).select("o_custkey", "l_partkey", "pnlpercent"))


_KW = [("widget", "WIDGET"), ("ring", "RING"), ("bolt", "BOLT"), ("gear", "GEAR"), ("small", "SMALLCAP"), ("hot", "ENERGY")]
_KW_SQL = "CASE " + " ".join(f"WHEN contains(upper(u), '{w.upper()}') THEN '{k}'" for w, k in _KW) + " ELSE 'Unknown' END"
_FUND = """fund AS (SELECT 'E' || l_partkey AS symbol, p_name AS u, max(p_retailprice) AS close, sum(l_quantity) * 100 AS volume FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, p_name)"""


def funds(spark, d):
    """Funds: part name as the underlying, list price and traded quantity."""
    v = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.sum("l_quantity") * 100).alias("volume"))
    p = table(spark, d, "part")
    return v.join(p, v.l_partkey == p.p_partkey).select(F.concat(F.lit("E"), "l_partkey").alias("symbol"), F.col("p_name").alias("underlying"), F.col("p_retailprice").alias("close"), "volume")


@query("a12_top_per_category", with_(_FUND, f"q AS (SELECT symbol, close * volume AS weight, {_KW_SQL} AS category FROM fund WHERE volume >= 10000 AND NOT contains(lower(u), 'gizmo') AND NOT contains(lower(symbol), 'gizmo') AND symbol NOT IN ('E1', 'E2')), b AS (SELECT category, arg_max(symbol, row(weight, symbol)) AS symbol, max(weight) AS weight FROM q WHERE category <> 'Unknown' GROUP BY category)",
  body="SELECT category, symbol, round(weight, 2) AS weight, round(least(1.0, weight / max(weight) OVER ()), 4) AS conviction FROM b"))
def a12(spark, d):
    t = rp.top_per_category(funds(spark, d), _KW, ["gizmo"], ["E1", "E2"])
    return t.select("category", "symbol", rnd("weight", 2).alias("weight"), rnd("conviction").alias("conviction"))


@query("a13_keep_largest", "SELECT n_name AS symbol, max(s_acctbal) AS ffmc, arg_max(s_suppkey, row(s_acctbal, s_suppkey)) AS s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def a13(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    t = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("symbol"), F.col("s_acctbal").alias("ffmc"), "s_suppkey")
    return B.keep_last(t, ["symbol"], F.struct("ffmc", "s_suppkey")).select("symbol", "ffmc", "s_suppkey")


@query("a14_keep_last", "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS amount FROM lineitem GROUP BY 1, 2")
def a14(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("amount"), "l_orderkey", "l_linenumber", "l_partkey")
    return B.keep_last(t, ["symbol", "date"], F.struct("l_orderkey", "l_linenumber", "l_partkey", "amount")).select("symbol", "date", "amount")


@query("a15_union_universe", with_(MASTER, body="SELECT DISTINCT symbol FROM (SELECT symbol FROM master WHERE acctbal > 5000 UNION ALL SELECT symbol FROM master WHERE sector = 'ASIA')"))
def a15(spark, d):
    m = suppliers(spark, d)
    return m.filter(c.acctbal > 5000).select("symbol").union(m.filter(c.sector == "ASIA").select("symbol")).distinct().orderBy("symbol")


@query("a16_latest_bar", with_(BARS["s"], body="SELECT symbol, max(date) AS date, round(arg_max(close, date), 4) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY symbol"))
def a16(spark, d):
    return B.latest_bars(supplier_bars(spark, d)).select("symbol", "date", rnd("close").alias("close"), "volume")


_NUM = ["open", "high", "low", "close", "volume", "sma_20", "sma_200"]


@query("a17_audit_profile", panel("s", body=" UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) FILTER (WHERE {x} IS NULL) AS nulls, round(min({x}), 4) AS lowest, round(max({x}), 4) AS highest, round(avg({x}), 4) AS mean FROM panel" for x in _NUM)))
def a17(spark, d):
    return rounded(rp.audit_profile(ind.sma(supplier_bars(spark, d), (20, 200)), _NUM))


_LATEST = f"lt AS (SELECT *, CASE WHEN pc > 0 THEN (close - pc) * 100.0 / pc ELSE 0 END AS change_pct FROM (SELECT *, lag(close) {W} AS pc, lead(date) {W} IS NULL AS il FROM bars) WHERE il), li AS (SELECT lt.*, sector AS index_name FROM lt JOIN master USING (symbol))"


def latest_change(spark, d):
    b = supplier_bars(spark, d).withColumn("prev_close", ts.lag(c.close))
    t = ts.latest(b).withColumn("change_pct", F.when(c.prev_close > 0, (c.close - c.prev_close) * 100.0 / c.prev_close).otherwise(0.0))
    return t.join(suppliers(spark, d).select("symbol", F.col("sector").alias("index_name")), "symbol")


def _mover_sql(kind, col, o):
    return f"SELECT index_name, '{kind}' AS kind, row_number() OVER (PARTITION BY index_name ORDER BY {col} {o}, symbol) AS rank, symbol, round({col}, 4) AS value FROM li QUALIFY rank <= 5"


@query("a18_movers", with_(BARS["s"], MASTER, _LATEST, body=" UNION ALL ".join(f"({_mover_sql(*x)})" for x in (("gainer", "change_pct", "DESC"), ("loser", "change_pct", "ASC"), ("active_value", "turnover", "DESC"), ("active_volume", "volume", "DESC")))
  + " UNION ALL SELECT index_name, 'advances', 0, '', CAST(count(*) FILTER (WHERE change_pct > 0) AS DOUBLE) FROM li GROUP BY 1 UNION ALL SELECT index_name, 'declines', 0, '', CAST(count(*) FILTER (WHERE change_pct < 0) AS DOUBLE) FROM li GROUP BY 1 UNION ALL SELECT index_name, 'unchanged', 0, '', CAST(count(*) FILTER (WHERE change_pct = 0) AS DOUBLE) FROM li GROUP BY 1"))
def a18(spark, d):
    t = written(latest_change(spark, d))  # one row per symbol, read by both parts
    b = rp.breadth(t).unpivot(["index_name"], ["advances", "declines", "unchanged"], "kind", "value")
    b = b.select("index_name", "kind", F.lit(0).alias("rank"), F.lit("").alias("symbol"), F.col("value").cast("double").alias("value"))
    return rounded(rp.movers(t).unionByName(b))


@query("a19_oi_quadrants", with_(BARS["s"], f"x AS (SELECT volume - lag(volume) {W} AS d_oi, close - lag(close) {W} AS d_price FROM bars)",
  body="SELECT CASE WHEN d_oi > 0 THEN 'Rise' ELSE 'Slide' END || ' in OI / ' || CASE WHEN d_price > 0 THEN 'Rise' ELSE 'Slide' END || ' in price' AS quadrant, count(*) AS n, round(avg(d_price), 4) AS avg_d_price FROM x WHERE d_oi <> 0 AND d_price <> 0 GROUP BY 1"))
def a19(spark, d):
    b = supplier_bars(spark, d).withColumns({"d_oi": ts.diff(c.volume), "d_price": ts.diff(c.close)})
    return rounded(rp.oi_quadrants(b))


@query("a20_heatmap", with_(BARS["s"], MASTER, _LATEST, body="SELECT symbol, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(change_pct, 4) AS change_pct, round(acctbal * 1e9 / 1e7, 4) AS market_cap_cr FROM lt JOIN master USING (symbol)"))
def a20(spark, d):
    t = latest_change(spark, d).join(suppliers(spark, d).select("symbol", (c.acctbal * 1e9).alias("ffmc")), "symbol")
    return rounded(rp.heatmap(t))


_SECT = {"final": ("trend_status = 'In Bull Run' AND car_rating = 'Buy/Average Out'", "-traded_value"), "bull_sl": ("trend_status_sl = 'In Bull Run (SL)' AND car_rating = 'Buy/Average Out'", "close"), "swing": ("bottom_out_status IN ('Start GTT', 'Start GTT (Basic)')", "-traded_value")}


@query("a21_sections_report", list_sql(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS section, row_number() OVER (ORDER BY {o}, symbol) AS position, symbol, round(close, 4) AS close, greatest(count(*) OVER () - 5, 0) AS more FROM lists WHERE {w}) WHERE position <= 5" for k, (w, o) in _SECT.items())))
def a21(spark, d):
    t = lists(spark, d)
    s = {"final": (rp.in_final(), -c.traded_value), "bull_sl": (rp.in_bull_sl(), F.col("close")), "swing": (rp.in_swing(), -c.traded_value)}
    return rounded(rp.sections_report(t, s))


_IDX = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("a22_membership_flags", with_(MASTER, body="SELECT symbol, " + ", ".join(f"bool_or(sector = '{x}') AS \"{x}\"" for x in _IDX) + " FROM master GROUP BY symbol"))
def a22(spark, d):
    return rp.membership_flags(suppliers(spark, d).select("symbol", F.col("sector").alias("index_name")), _IDX)


@query("a23_net_position", "SELECT coalesce((SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 1), '0') AS net_qty")
def a23(spark, d):
    p = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_returnflag").alias("product"), F.col("l_quantity").cast("long").alias("net_qty"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("row_no")
    )
    return rp.net_position(p, "7", "R")


# ---- joins ----------------------------------------------------------------------


@query("j1_master_enrichment", "SELECT s_suppkey, s_name, n_name, ffmc FROM supplier LEFT JOIN (SELECT n_nationkey, any_value(n_name) AS n_name, max(c_acctbal) AS ffmc FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey) e ON s_nationkey = n_nationkey")
def j1(spark, d):
    s, n, k = (table(spark, d, t) for t in ("supplier", "nation", "customer"))
    best = k.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.max("c_acctbal").alias("ffmc"))  # one row per nation: 25
    dim = n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name").join(best, "s_nationkey")
    return s.join(F.broadcast(dim), "s_nationkey", "left").select("s_suppkey", "s_name", "n_name", "ffmc")


@query("j2_close_turnover", with_(BARS["g"], body="SELECT a.date, round(a.close, 4) AS close_a, round(b.turnover, 2) AS turnover_b FROM bars a JOIN bars b ON a.date = b.date WHERE a.symbol = 'RF' AND b.symbol = 'NO'"))
def j2(spark, d):
    b = segment_bars(spark, d)
    x = b.filter(c.symbol == "RF").select("date", rnd("close").alias("close_a"))
    return x.join(b.filter(c.symbol == "NO").select("date", rnd("turnover", 2).alias("turnover_b")), "date", "inner")


_DELIV = "dl AS (SELECT symbol, date, deliv_pct FROM bars WHERE volume > 30)"


@query("j3_delivery_asof", with_(BARS["s"], _DELIV, body="SELECT b.symbol, b.date, round(coalesce(last_value(dl.deliv_pct IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS UNBOUNDED PRECEDING), 0), 4) AS deliv_pct FROM bars b LEFT JOIN dl ON b.symbol = dl.symbol AND b.date = dl.date"))
def j3(spark, d):
    b = supplier_bars(spark, d)
    return rounded(pr.with_delivery(b.drop("deliv_pct"), b.filter(c.volume > 30).select("symbol", "date", "deliv_pct")).select("symbol", "date", "deliv_pct"))


@query("j4_benchmark_join", with_(BARS["s"], "bench AS (SELECT date, avg(close) AS bench FROM bars GROUP BY date)", body="SELECT symbol, date, round(close, 4) AS close, round(bench, 4) AS bench FROM bars JOIN bench USING (date)"))
def j4(spark, d):
    b = supplier_bars(spark, d)
    return rounded(pr.with_benchmark(b, index_close(b)).select("symbol", "date", "close", "bench"))


@query("j5_pair_join", with_(BARS["g"], body="SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.date, round(a.close, 4) AS close_a, round(b.close, 4) AS close_b FROM bars a JOIN bars b ON a.date = b.date AND a.symbol < b.symbol"))
def j5(spark, d):
    return rounded(pr.aligned_pairs(segment_bars(spark, d), ["AF", "AO", "NF", "NO", "RF", "RO"]))


@query("j6_semi_join", with_(BARS["s"], MASTER, body="SELECT symbol, date, round(close, 4) AS close, symbol IN (SELECT symbol FROM master WHERE acctbal > 5000) AS in_index FROM bars WHERE symbol IN (SELECT symbol FROM master WHERE sector <> 'ASIA')"))
def j6(spark, d):
    m = suppliers(spark, d)
    b = supplier_bars(spark, d).join(m.filter(c.sector != "ASIA").select("symbol"), "symbol", "left_semi")
    flagged = b.join(m.filter(c.acctbal > 5000).select("symbol", F.lit(True).alias("in_index")), "symbol", "left")
    return flagged.select("symbol", "date", rnd("close").alias("close"), F.coalesce("in_index", F.lit(False)).alias("in_index"))


@query("j7_anti_join", with_(BARS["s"], MASTER, body="SELECT symbol, date, round(close, 4) AS close FROM bars WHERE symbol NOT IN (SELECT symbol FROM master WHERE acctbal < 0)"))
def j7(spark, d):
    bad = suppliers(spark, d).filter(c.acctbal < 0).select("symbol")
    return rounded(supplier_bars(spark, d).join(bad, "symbol", "left_anti").select("symbol", "date", "close"))


@query("j8_weekly_lookup", with_(BARS["s"], WEEKLY, body="SELECT b.symbol, max(b.date) AS date, coalesce(bool_or(weekly_cross), false) AS weekly_cross FROM bars b LEFT JOIN weekly w ON w.symbol = b.symbol AND CAST(b.symbol AS BIGINT) % 7 <> 0 GROUP BY b.symbol"))
def j8(spark, d):
    """Latest bars with the cross of a stored weekly table; every seventh supplier has no weekly row and is not confirmed."""
    b = supplier_bars(spark, d)
    weekly = written(tr.weekly_cross(b).filter(c.symbol.cast("long") % 7 != 0))
    return B.latest_bars(b).join(weekly, "symbol", "left").select("symbol", "date", F.coalesce("weekly_cross", F.lit(False)).alias("weekly_cross"))


@query("j9_keyword_category", f"SELECT p_partkey, {_KW_SQL} AS category FROM (SELECT p_partkey, p_name AS u FROM part)")
def j9(spark, d):
    return table(spark, d, "part").select("p_partkey", rp.keyword_category(c.p_name, _KW).alias("category"))


@query("j10_symbol_lookup", """SELECT o_orderkey, coalesce(s_name, 'BR' || k) AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'NSE' WHEN o_orderkey % 3 = 1 THEN 'NFO' ELSE 'Unknown Exchange' END AS exchange FROM (SELECT o_orderkey, o_custkey % 200 AS k FROM orders)
  LEFT JOIN supplier ON s_suppkey = k AND s_suppkey % 3 = CASE WHEN o_orderkey % 3 = 2 THEN 9 ELSE o_orderkey % 3 END""")
def j10(spark, d):
    from ..operators.broker import map_symbols

    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("BR"), c.o_custkey % 200).alias("brsymbol"), F.lit(10).alias("exchange_code"), F.element_at(F.array(F.lit(10), F.lit(11), F.lit(99)), (c.o_orderkey % 3 + 1).cast("int")).alias("segment_code"))
    k = table(spark, d, "supplier").select(F.concat(F.lit("BR"), "s_suppkey").alias("brsymbol"), F.when(c.s_suppkey % 3 == 0, "NSE").when(c.s_suppkey % 3 == 1, "NFO").otherwise("CDS").alias("exchange"), F.col("s_name").alias("symbol"))
    return map_symbols(o, k).select("o_orderkey", "symbol", "exchange")


@query("j11_universe_placeholder", panel("s", D200, CAR3, BOTTOM, _LISTS, "u AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol FROM customer), n AS (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol)",
  body="SELECT u.symbol, CASE WHEN n_bars IS NULL OR n_bars < 2 THEN 'TICKER NOT FOUND' ELSE trend_status END AS trend_status, CASE WHEN n_bars IS NULL OR n_bars < 2 THEN 'TICKER NOT FOUND' ELSE car_rating END AS car_rating, round(close, 4) AS close, CASE WHEN n_bars IS NULL THEN 'MISSING_PARQUET' WHEN n_bars < 2 THEN 'INSUFFICIENT_HISTORY' ELSE 'PRESENT' END AS dq_status FROM u LEFT JOIN n USING (symbol) LEFT JOIN (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) l USING (symbol)"))
def j11(spark, d):
    u = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"))
    rows = lists(spark, d).select("symbol", "date", "close", "prev_close", "sma_50", "sma_200", "trend_status", "car_rating", "bottom_out_status", F.count(F.lit(1)).over(ts.whole()).alias("n_bars"))
    snap = written(ts.latest(rows))  # one row per symbol
    n, snap = snap.select("symbol", "n_bars"), snap.drop("n_bars")
    return with_universe(u, snap, n).select("symbol", "trend_status", "car_rating", rnd("close").alias("close"), "dq_status")


