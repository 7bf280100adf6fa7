"""Tick and depth queries on the events table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.num import c
from ..session import work_folder, written
from ..streaming import ticks as tk
from .catalog import query
from .sqltext import TICKS, with_
from .tables import rounded, table, ticks

_RAW = """raw AS (SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'NSE' ELSE 'BSE' END AS ex, 'S' || user_id AS sym, event_type = 'signup' AS is_index, CAST(round(value * 100) AS BIGINT) AS ltp FROM events)"""


def raw_ticks(spark, d):
    """Raw integer ticks with a topic name: sign-ups play the indices."""
    e = table(spark, d, "events")
    idx = c.event_type == "signup"
    topic = F.concat(F.when(idx, "NSE").otherwise("BSE"), F.lit(":S"), "user_id", F.when(idx, "-INDEX").otherwise("-EQ"))
    px = F.floor(c.value * 100 + 0.5)
    return e.select(
        F.col("event_id").alias("seq"), "ts", topic.alias("topic"), idx.alias("is_index"), px.alias("ltp"), (px + 5).alias("open_price"), (px + 10).alias("high_price"), (px - 10).alias("low_price"),
        F.lit(1).alias("multiplier"), F.lit(2).alias("precision"),
    )


@query("k1_quotes", with_(_RAW, body="SELECT seq, ex AS exchange, sym AS symbol, round(ltp / CASE WHEN is_index THEN 1.0 ELSE 100.0 END, 2) AS ltp, round((ltp + 10) / CASE WHEN is_index THEN 1.0 ELSE 100.0 END, 2) AS high_price FROM raw"))
def k1(spark, d):
    return tk.quotes(raw_ticks(spark, d)).select("seq", "exchange", "symbol", "ltp", "high_price")


@query("k2_last_price", with_(_RAW, body="SELECT seq, ex AS exchange, sym AS symbol, round(ltp / 100.0, 4) AS ltp FROM raw"))
def k2(spark, d):
    return rounded(tk.last_price(raw_ticks(spark, d)).select("seq", "exchange", "symbol", "ltp"))


def _ladders(spark, d):
    """Ladders from the embeddings: the first values are bid prices, the next ask prices (negative = empty level)."""
    e = table(spark, d, "embeddings")
    lev = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: F.struct((x.cast("double") * 100).alias("price"), F.lit(1).alias("quantity"), F.lit(1).alias("orders")))
    return e.select("vec_id", lev(1, 5).alias("bids"), lev(6, 5).alias("asks"))


_LAD = "lad AS (SELECT vec_id, list_filter(list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE) * 100), lambda x: x > 0) AS b, list_filter(list_transform(embedding[6:10], lambda x: CAST(x AS DOUBLE) * 100), lambda x: x > 0) AS a FROM embeddings)"


@query("k3_depth_ladder", with_(_LAD, body="SELECT vec_id, CAST(len(b) AS INTEGER) AS bid_levels, CAST(len(a) AS INTEGER) AS ask_levels, round(coalesce((b[1] + a[1]) / 2, 0), 4) AS mid FROM lad"))
def k3(spark, d):
    return rounded(tk.depth_ladder(_ladders(spark, d)).select("vec_id", F.size("bids").alias("bid_levels"), F.size("asks").alias("ask_levels"), "mid"))


@query("k4_synthetic_depth", with_(_RAW, body="SELECT seq, i AS level, round(ltp / 100.0 * (1 - 0.0005 * i), 4) AS bid, round(ltp / 100.0 * (1 + 0.0005 * i), 4) AS ask, CAST(1000 * (6 - i) AS INTEGER) AS quantity FROM (SELECT seq, ltp, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS i FROM raw WHERE is_index)"))
def k4(spark, d):
    t = tk.synthetic_depth(tk.last_price(raw_ticks(spark, d).filter("is_index")))
    x = t.select("seq", F.posexplode(F.arrays_zip("bids", "asks")).alias("p", "z"))
    return rounded(x.select("seq", (c.p + 1).alias("level"), F.col("z.bids.price").alias("bid"), F.col("z.asks.price").alias("ask"), F.col("z.bids.quantity").alias("quantity")))


@query("k5_depth_padding", with_(_LAD, body="SELECT vec_id, 5 AS levels, round(list_sum(b), 4) AS total FROM lad WHERE len(b) > 0 UNION ALL SELECT vec_id, 5, CAST(0 AS DOUBLE) FROM lad WHERE len(b) = 0"))
def k5(spark, d):
    t = tk.depth_ladder(_ladders(spark, d)).withColumn("p", tk.pad_levels(c.bids))
    return rounded(t.select("vec_id", F.size("p").alias("levels"), F.aggregate("p", F.lit(0.0), lambda a, x: a + x["price"]).alias("total")))


@query("k6_validity", with_(_RAW, body="SELECT seq FROM raw WHERE ltp > 500"))
def k6(spark, d):
    t = tk.quotes(raw_ticks(spark, d)).withColumn("ltp", F.when(c.ltp * F.when(c.is_index, 1.0).otherwise(100.0) > 500, c.ltp))
    return tk.valid(t, ("ltp",)).select("seq")


_DELTA = f"""dl AS (SELECT CAST(user_id AS VARCHAR) AS topic, ts, event_id AS seq, CASE WHEN event_type <> 'view' THEN value END AS ltp, CASE WHEN event_type IN ('click', 'purchase') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS volume FROM events),
fl AS (SELECT topic, ts, seq, last_value(ltp IGNORE NULLS) OVER w AS ltp, last_value(volume IGNORE NULLS) OVER w AS volume FROM dl WINDOW w AS (PARTITION BY topic ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
ch AS (SELECT *, lag(ltp) OVER w AS pl, lag(volume) OVER w AS pv FROM fl WINDOW w AS (PARTITION BY topic ORDER BY ts, seq))"""


def deltas(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").cast("string").alias("topic"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.when(c.event_type != "view", c.value).otherwise(F.lit(float(tk.KEEP))).alias("ltp"), F.when(c.event_type.isin("click", "purchase"), k).alias("volume"),
    )


@query("k7_snapshot_delta", with_(_DELTA, body="SELECT topic, seq, ltp, volume FROM ch WHERE ltp IS DISTINCT FROM pl OR volume IS DISTINCT FROM pv"))
def k7(spark, d):
    return tk.merge_deltas(deltas(spark, d), ["ltp", "volume"]).select("topic", "seq", "ltp", "volume")


@query("k7_delta_batches", with_(_DELTA, body="SELECT topic, seq, ltp, volume FROM ch WHERE ltp IS DISTINCT FROM pl OR volume IS DISTINCT FROM pv"))
def k7_batches(spark, d):
    """The same ticks as micro-batches of ten days, with the state of each topic between them."""
    t = written(deltas(spark, d))
    merger = tk.DeltaMerger(["ltp", "volume"], work_folder(spark))
    first, last = t.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    day, n = first, 0
    while day <= last:
        merger(t.filter((F.to_date("ts") >= F.lit(day)) & (F.to_date("ts") < F.date_add(F.lit(day), 10))), n)
        day, n = day + dt.timedelta(days=10), n + 1
    return merger.rows(spark).select("topic", "seq", "ltp", "volume")


@query("k8_repeat_filter", with_("t AS (SELECT event_type AS symbol, ts, event_id AS seq, floor(value / 50) AS price FROM events), u AS (SELECT *, lag(price) OVER (PARTITION BY symbol, date_trunc('second', ts) ORDER BY ts, seq) AS pp FROM t)", body="SELECT symbol, seq FROM u WHERE pp IS NULL OR pp <> price"))
def k8(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.floor(c.value / 50).alias("price"))
    return tk.drop_repeats(e).select("symbol", "seq")


@query("k9_topic_key", "SELECT event_id AS seq, 'NSE_S' || user_id || '_' || upper(event_type) AS key FROM events")
def k9(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), tk.topic_key(F.lit("NSE"), F.concat(F.lit("S"), "user_id"), F.upper("event_type")).alias("key"))


@query("k10_tick_bars", with_(TICKS, body="SELECT symbol, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01') AS start, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close, count(*) AS ticks FROM ticks GROUP BY symbol, start"))
def k10(spark, d):
    t = tk.tick_bars(ticks(spark, d), "15 minutes")
    return t.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "ticks")
