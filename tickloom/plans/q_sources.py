"""Sources and ingestion.  Raw file shapes are derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, rnd
from ..operators import broker as bk
from ..operators import indicators as ind
from ..sources import bars as B
from ..sources import files as fl
from ..session import work_folder
from .catalog import query
from .sqltext import BARS, MASTER, panel, with_
from .tables import latest_supplier_bars, rounded, segment_bars, supplier_bars, suppliers, table


@query("s1_symbol_from_file", "SELECT 'lineitem' AS symbol, l_returnflag, count(*) AS n, sum(l_quantity) AS volume FROM lineitem GROUP BY l_returnflag")
def s1(spark, d):
    t = fl.read_symbol_files(spark, f"{d}/lineitem.parquet")
    return t.groupBy("symbol", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("volume"))


@query("s2_sql_over_prices", with_(BARS["s"], body="SELECT symbol, count(*) AS n, round(avg(close), 4) AS avg_close FROM bars WHERE date >= DATE '1997-01-01' GROUP BY symbol"))
def s2(spark, d):
    t = B.sql_over_prices(supplier_bars(spark, d), "SELECT symbol, count(*) AS n, avg(close) AS avg_close FROM prices WHERE date >= :start GROUP BY symbol", {"start": "1997-01-01"})
    return rounded(t)


@query("s3_get_prices", with_(BARS["s"], body="SELECT symbol, date, round(open, 4) AS open, round(close, 4) AS close, volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def s3(spark, d):
    return rounded(B.prices(supplier_bars(spark, d), start="1996-01-01", end="1998-12-31").select("symbol", "date", "open", "close", "volume"))


def daily_files(spark, d):
    """Folder of daily CSV files written from the supplier bars: one file per day in a folder named by it, old headers
    (blanks, turnover in lacs) up to 1997 and new ones, with quoted names, after. Some lines are cut short."""
    b = supplier_bars(spark, d)
    t = lambda x: F.col(x).cast("string")
    old = c.date < "1998-01-01"
    cells = [
        F.concat(F.lit("S"), "symbol"), F.when(c.volume > 5, "EQ").otherwise("BE"), t("open"), t("high"), F.when(c.volume % 7 == 0, "-").otherwise(t("low")), t("close"),
        F.when(c.volume % 5 == 0, "").otherwise(F.when(old, (rnd("turnover", 2) / 100000.0).cast("string")).otherwise(rnd("turnover", 2).cast("string"))), t("volume"), F.lit("-"), t("deliv_pct"),
    ]
    heads = [
        " SYMBOL, SERIES, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TURNOVER_LACS, TTL_TRD_QNTY, DELIV_QTY, DELIV_PER",
        "TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTrfVal,TtlTradgVol,DlvrbleQty,PctOfDlvrbleQtyTltTrdQty,FinInstrmNm",
    ]
    whole = F.when(old, F.concat_ws(",", *cells)).otherwise(F.concat_ws(",", *cells, F.concat(F.lit('"Supplier, '), "symbol", F.lit('"'))))
    short = F.when(c.volume % 3 == 0, F.concat_ws(",", *cells[:4]))
    lines = F.array_compact(F.array(F.struct(F.lit(1).alias("k"), whole.alias("value")), F.when(short.isNotNull(), F.struct(F.lit(2).alias("k"), short.alias("value")))))
    rows = b.select(F.date_format("date", "yyyyMMdd").alias("day"), F.inline(lines))
    # the days of the trades are those of the bars
    days = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    first = days.select(F.date_format("date", "yyyyMMdd").alias("day"), F.lit(0).alias("k"), F.when(old, heads[0]).otherwise(heads[1]).alias("value"))
    at = work_folder(spark)
    # a day's lines are rows of one task and follow their header into one file
    rows.union(first).repartition("day").sortWithinPartitions("day", "k").select("day", "value").write.partitionBy("day").text(at)
    return at


def _daily(spark, d):
    # Spark names its own files, so the day is in the folder's name here
    return fl.read_daily_files(spark, daily_files(spark, d), day_pattern=r"day=(\d{8})", day_in="path")


@query("s4_normalise_daily", with_(BARS["s"], body="SELECT 'S' || symbol AS symbol, date, round(CASE WHEN date < DATE '1998-01-01' THEN round(turnover, 2) / 100000.0 * 100000.0 ELSE round(turnover, 2) END, 2) AS turnover, round(close, 4) AS close, CAST(NULL AS DOUBLE) AS deliv_qty, round(deliv_pct, 4) AS deliv_pct FROM bars WHERE volume > 5 AND volume % 5 <> 0"))
def s4(spark, d):
    t = fl.normalise_daily(_daily(spark, d), keep=["day"])
    return t.select("symbol", F.col("day").alias("date"), rnd("turnover", 2).alias("turnover"), rnd("close").alias("close"), "deliv_qty", rnd("deliv_pct").alias("deliv_pct"))


@query("s4_ragged_lines", with_(BARS["s"], body="""SELECT date AS day, count(*) + count(*) FILTER (volume % 3 = 0) AS lines, count(*) FILTER (volume % 3 = 0) AS ragged FROM bars GROUP BY date"""))
def s4_ragged(spark, d):
    """Lines of each daily file, and those that do not fit its header."""
    return fl.ragged_lines(spark, daily_files(spark, d), day_pattern=r"day=(\d{8})", day_in="path").select("day", "lines", "ragged")


@query("s5_daily_ohlcv", with_(BARS["s"], body="SELECT 'S' || symbol AS symbol, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM bars WHERE volume > 5 AND volume % 7 <> 0"))
def s5(spark, d):
    return rounded(fl.daily_ohlcv(_daily(spark, d), F.col("day")).select("symbol", "date", "open", "high", "low", "close", "volume"))


@query("s6_top_by_turnover", with_(BARS["s"], body="SELECT symbol, round(sum(turnover), 2) AS turnover FROM bars GROUP BY symbol ORDER BY turnover DESC, symbol LIMIT 50"))
def s6(spark, d):
    t = supplier_bars(spark, d).groupBy("symbol").agg(rnd(F.sum("turnover"), 2).alias("turnover"))
    return fl.top_by_turnover(t, 50)


@query("s7_tradable_symbols", with_(BARS["s"], MASTER, body="SELECT DISTINCT symbol FROM bars WHERE symbol IN (SELECT symbol FROM master WHERE acctbal > 0)"))
def s7(spark, d):
    return fl.tradable(supplier_bars(spark, d), suppliers(spark, d).filter(c.acctbal > 0))


@query("s8_delivery_history", with_(BARS["s"], body="SELECT symbol, date, round(deliv_pct, 4) AS deliv_pct FROM bars"))
def s8(spark, d):
    t = _daily(spark, d)
    return rounded(t.select(F.substring("SYMBOL", 2, 100).alias("symbol"), F.col("day").alias("date"), F.col(fl.ALIASES["deliv_pct"][0]).try_cast("double").alias("deliv_pct")))


@query("s9_candle_arrays", with_(BARS["s"], body="SELECT symbol, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM bars"))
def s9(spark, d):
    b = supplier_bars(spark, d)
    row = F.to_json(F.array(F.array(F.unix_timestamp(F.col("date").cast("timestamp")).cast("double"), *[F.col(x) for x in ("open", "high", "low", "close", "volume")])))
    return rounded(fl.candles_to_bars(b.select("symbol", row.alias("payload"))))


@query("s10_chunk_concat", with_(BARS["s"], body="SELECT symbol, date, round(close, 4) AS close, CAST(CASE WHEN date <= DATE '1998-06-30' THEN 0 ELSE volume END AS DOUBLE) AS oi FROM bars"))
def s10(spark, d):
    b = supplier_bars(spark, d)
    first = b.filter(c.date <= "1998-06-30").select("symbol", "date", "close")
    second = b.filter(c.date >= "1998-01-01").select("symbol", "date", "close", F.col("volume").alias("oi"))
    return rounded(B.concat_chunks([first, second]))


@query("s11_source_priority", with_(BARS["s"], body="SELECT symbol, date, round(close, 4) AS close, CASE WHEN CAST(symbol AS INTEGER) % 3 = 0 THEN 0 WHEN CAST(symbol AS INTEGER) % 3 = 1 THEN 1 ELSE 2 END AS source FROM bars"))
def s11(spark, d):
    b = supplier_bars(spark, d).select("symbol", "date", "close")
    k = F.col("symbol").cast("int") % 3
    return rounded(B.first_source([b.filter(k == 0), b.filter(k <= 1), b]))


@query("s12_symbol_normalise", "SELECT p_partkey, upper(trim(p_name)) AS base, 'NSE:' || upper(trim(p_name)) || '-EQ' AS exchange_form, upper(trim(p_name)) || '.NS' AS suffix_form FROM part")
def s12(spark, d):
    p = table(spark, d, "part")
    raw = F.when(c.p_partkey % 3 == 0, F.concat(F.lit(" nse:"), "p_name", F.lit("-eq "))).when(c.p_partkey % 3 == 1, F.concat("p_name", F.lit(".ns"))).otherwise(F.concat("p_name", F.lit(".BO")))
    return p.select("p_partkey", fl.normalise_symbol(raw).alias("base"), fl.exchange_symbol(raw).alias("exchange_form"), fl.suffixed_symbol(raw).alias("suffix_form"))


@query("s13_report_sink", with_(BARS["g"], body="SELECT symbol, count(*) AS n, sum(volume) AS volume FROM bars GROUP BY symbol"))
def s13(spark, d):
    """The report as it is read back from the sink."""
    at = work_folder(spark)
    fl.save(segment_bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")), at)
    return spark.read.parquet(at)


def contract_rows(spark, d):
    """Contract-master shaped rows from the parts: every third an equity, a future, an option."""
    p = table(spark, d, "part")
    k = c.p_partkey
    up = F.upper(F.split("p_name", " ")[1])
    return p.select(
        F.concat(F.lit("T"), k).alias("token"),
        F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(up, F.lit(" 26 Jun 25 FUT"))).otherwise(F.concat(up, F.lit(" 26 Jun 25 "), c.p_size.cast("string"), F.lit(" CE"))).alias("details"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, 0).otherwise(10)).otherwise(11).alias("instrument"), c.p_size.alias("lotsize"), F.lit(0.05).alias("tick_size"),
        F.lit("1750896000").alias("expiry_epoch"), F.concat(F.lit("NSE:"), up, k.cast("string")).alias("ticker"), up.alias("underlying"), c.p_retailprice.alias("strike"), F.when(k % 3 == 1, "XX").otherwise("CE").alias("option_type"),
    )


_CON = """con AS (SELECT 'T' || p_partkey AS token, p_partkey % 3 AS k, p_partkey % 2 AS h, upper(split_part(p_name, ' ', 2)) AS u, p_size, p_partkey, p_retailprice FROM part),
contracts AS (SELECT token, CASE WHEN k = 0 THEN u WHEN k = 1 THEN u || '25JUN26FUT' ELSE u || '25JUN26' || p_size || 'CE' END AS symbol, 'NSE:' || u || p_partkey AS brsymbol, CASE WHEN k = 0 THEN CASE WHEN h = 0 THEN 'NSE' ELSE 'NSE_INDEX' END ELSE 'NFO' END AS exchange,
  CASE WHEN k = 0 THEN '1750896000' ELSE '26-JUN-25' END AS expiry, CASE WHEN k = 0 THEN CASE WHEN h = 0 THEN 'EQ' ELSE 'INDEX' END WHEN k = 1 THEN 'FUT' ELSE 'CE' END AS instrumenttype, p_size AS lotsize FROM con)"""


def contracts(spark, d):
    r = contract_rows(spark, d)
    cash = bk.cash_contracts(r.filter(c.instrument != 11), "NSE_CM")
    return cash.unionByName(bk.derivative_contracts(r.filter(c.instrument == 11), "NSE_FO"))


@query("s14_contract_master", with_(_CON, body="SELECT token, symbol, brsymbol, exchange, expiry, instrumenttype, lotsize FROM contracts WHERE CAST(substr(token, 2) AS INTEGER) > 10"))
def s14(spark, d):
    loaded = table(spark, d, "part").filter(c.p_partkey <= 10).select(F.concat(F.lit("T"), "p_partkey").alias("token"))
    return bk.new_contracts(contracts(spark, d), loaded).select("token", "symbol", "brsymbol", "exchange", "expiry", "instrumenttype", "lotsize")


@query("s15_contract_search", with_(_CON, body="SELECT token, symbol FROM contracts WHERE symbol LIKE '%GEAR%' AND exchange = 'NFO'"))
def s15(spark, d):
    return bk.search(contracts(spark, d), "GEAR", "NFO").select("token", "symbol")


@query("s16_nested_json", with_(BARS["g"], body="SELECT symbol AS index_name, count(*) AS n, round(sum(close), 2) AS total FROM bars WHERE volume % 4 <> 0 GROUP BY symbol"))
def s16(spark, d):
    b = segment_bars(spark, d)
    item = F.struct(F.when(c.volume % 4 == 0, " ").otherwise(F.col("symbol")).alias("key"), F.col("close").alias("last"))
    rows = b.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("payload"))
    t = fl.nested_rows(rows, "payload", "key:string,last:double", {"key": "index_name", "last": "close"}, "index_name")
    return t.groupBy("index_name").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("close"), 2).alias("total"))


@query("s17_ban_list", "SELECT DISTINCT upper(split_part(p_name, ' ', 2)) AS symbol FROM part")
def s17(spark, d):
    p = table(spark, d, "part")
    line = F.when(c.p_partkey % 9 == 0, F.concat(F.lit("Symbol, "), F.split("p_name", " ")[1])).otherwise(F.concat(F.lit("- , "), F.split("p_name", " ")[1], F.lit(", EQ")))
    return fl.ban_list(p.select(line.alias("line")))


def _chain_rows(spark, d):
    p = table(spark, d, "part")
    side = lambda z: F.struct(F.col("p_size").cast("double").alias("openInterest"), (c.p_size - z).cast("double").alias("changeinOpenInterest"), (c.p_retailprice * z).alias("lastPrice"))
    row = F.struct(F.lit("26-Jun-2025").alias("expiryDate"), c.p_retailprice.alias("strikePrice"), F.when(c.p_partkey % 4 != 0, side(2)).alias("CE"), side(3).alias("PE"))
    js = F.to_json(F.struct(F.struct(F.array(row).alias("data")).alias("records")))
    return p.select(c.p_partkey.cast("string").alias("symbol"), js.alias("payload"))


@query("s18_option_chain", """SELECT CAST(p_partkey AS VARCHAR) AS symbol, '26-Jun-2025' AS expiry_date, round(p_retailprice, 4) AS strike_price, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) ELSE 0 END AS calls_oi, CASE WHEN p_partkey % 4 <> 0 THEN round(p_retailprice * 2, 4) ELSE 0 END AS calls_ltp,
  CAST(p_size AS DOUBLE) AS puts_oi, CAST(p_size - 3 AS DOUBLE) AS puts_chng_in_oi, round(p_retailprice * 3, 4) AS puts_ltp, CAST(0 AS DOUBLE) AS puts_iv FROM part""")
def s18(spark, d):
    return rounded(fl.option_chain(_chain_rows(spark, d), expiry="26-Jun-2025").select("symbol", "expiry_date", "strike_price", "calls_oi", "calls_ltp", "puts_oi", "puts_chng_in_oi", "puts_ltp", "puts_iv"))


@query("s19_high_low_lookup", panel("s", body="SELECT symbol, date, round(high_252, 4) AS year_high, round(low_252, 4) AS year_low FROM panel WHERE is_last"))
def s19(spark, d):
    return rounded(fl.high_low_lookup(ts.latest(ind.extremes(supplier_bars(spark, d)))))


@query("s20_latest_dataset", with_(BARS["s"], body="SELECT symbol, date, round(close, 4) AS close FROM bars WHERE date = (SELECT max(date) FROM bars)"))
def s20(spark, d):
    return rounded(latest_supplier_bars(spark, d).select("symbol", "date", "close"))


