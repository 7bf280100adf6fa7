"""Tick, quote and depth operators; the same column code serves batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.num import c, truth
from ..session import written
from ..sources.bars import intraday_bars

KEEP = -2147483648  # fixed value: "field unchanged" in raw 32-bit ticks
LEVELS = 5


def split_topic(t: Column) -> tuple[Column, Column]:
    """EXCH:SYM-SUFFIX to (exchange, symbol)."""
    return F.regexp_extract(t, r"^([^:]+):", 1), F.regexp_replace(F.regexp_replace(t, r"^[^:]+:", ""), r"-[A-Z]+$", "")


def _round_to(x: Column, digits: Column) -> Column:
    scale = F.pow(F.lit(10.0), digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def quotes(raw: DataFrame, prices: tuple[str, ...] = ("ltp", "open_price", "high_price", "low_price")) -> DataFrame:
    """Raw integer ticks to quotes: price / multiplier, further / 100 unless the topic is an index, rounded to the precision."""
    ex, sym = split_topic(c.topic)
    unit = F.when(c.is_index, 1.0).otherwise(100.0)
    out = {p: _round_to(F.col(p) / c.multiplier / unit, c.precision) for p in prices}
    return raw.withColumns({"exchange": ex, "symbol": sym, **out})


def last_price(raw: DataFrame) -> DataFrame:
    """Symbol and last price (always / 100, also for an index)."""
    ex, sym = split_topic(c.topic)
    return raw.select(ex.alias("exchange"), sym.alias("symbol"), (c.ltp / c.multiplier / 100.0).alias("ltp"), *[x for x in ("ts", "seq") if x in raw.columns])


def depth_ladder(t: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """At most five levels per side without empty ones; ``mid`` of the best prices, 0 when a side is empty."""
    live = lambda x: F.slice(F.filter(x, lambda l: l["price"] > 0), 1, LEVELS)
    t = t.withColumns({bids: live(F.col(bids)), asks: live(F.col(asks))})
    best = lambda x: F.get(F.col(x), F.lit(0))["price"]
    return t.withColumn("mid", F.coalesce((best(bids) + best(asks)) / 2.0, F.lit(0.0)))


def synthetic_depth(t: DataFrame, price: str = "ltp") -> DataFrame:
    """Index ladders around the last price: 5 basis points per level, quantity 1000 * (6 - level)."""
    lv = F.sequence(F.lit(1), F.lit(LEVELS))

    def side(sign: int) -> Column:
        return F.transform(
            lv, lambda i: F.struct((F.col(price) * (1 + sign * 0.0005 * i)).alias("price"), (1000 * (6 - i)).alias("quantity"), F.lit(1).alias("orders"))
        )

    return t.withColumns({"bids": side(-1), "asks": side(1)})


def pad_levels(x: Column) -> Column:
    """Ladder of exactly five levels, missing ones zero."""
    zero = F.struct(F.lit(0.0).alias("price"), F.lit(0).alias("quantity"), F.lit(0).alias("orders"))
    return F.slice(F.concat(x, F.array_repeat(zero, LEVELS)), 1, LEVELS)


def valid(t: DataFrame, prices: tuple[str, ...]) -> DataFrame:
    """Rows with symbol, exchange and at least one positive price."""
    some = F.greatest(*[F.coalesce(F.col(p), F.lit(0.0)) for p in prices], F.lit(0.0)) > 0
    named = lambda x: truth(F.col(x) != "")
    return t.filter(named("symbol") & named("exchange") & some)


def merge_deltas(t: DataFrame, fields: list[str], segments: int | None = None) -> DataFrame:
    """Snapshot + delta ticks (topic, ts, seq, fields) to full rows; a row is kept when it changes any field.

    NULL and the sentinel mean "unchanged". A topic may hold most of all ticks, in one second even, so neither a topic nor
    a time slice of it is a window partition: ticks are range-cut by (topic, ts, seq) into segments of about equal size,
    whatever their topics. Values are filled inside a segment; the last value of each field in each segment (a map-side
    combined aggregate, one row per topic and segment) is scanned over a topic's segments and carried into the next ones.
    """
    x = t.withColumns({f: F.when(F.col(f) != KEEP, F.col(f)) for f in fields})
    cut = ["topic", "ts", "seq"]
    placed = x.repartitionByRange(segments, *cut) if segments else x.repartitionByRange(*cut)
    # written: both uses below have to see the same cut
    x = written(placed.withColumn("_s", F.spark_partition_id()))
    order = F.struct("ts", "seq")
    ends = x.groupBy("topic", "_s").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f"_e_{f}") for f in fields])
    before = W.partitionBy("topic").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select("topic", "_s", *[F.last(f"_e_{f}", ignorenulls=True).over(before).alias(f"_c_{f}") for f in fields])
    j = x.join(carry, ["topic", "_s"])
    inside = W.partitionBy("topic", "_s").orderBy("ts", "seq")
    sofar = inside.rowsBetween(W.unboundedPreceding, 0)
    filled = {f"_f_{f}": F.coalesce(F.last(f, ignorenulls=True).over(sofar), F.col(f"_c_{f}")) for f in fields}
    j = j.withColumns(filled)
    prev = {f"_p_{f}": F.coalesce(F.lag(f"_f_{f}").over(inside), F.col(f"_c_{f}")) for f in fields}
    j = j.withColumns(prev)
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"_f_{f}").eqNullSafe(F.col(f"_p_{f}"))
    return j.filter(changed).select("topic", "ts", "seq", *[F.col(f"_f_{f}").alias(f) for f in fields])


class DeltaMerger:
    """``foreachBatch`` form of :func:`merge_deltas`: each micro-batch is merged as a whole, so a hot topic spreads over
    tasks inside a batch too.

    Between batches there is one state row per topic, its last values and when it was last seen. It goes before the
    topic's rows of the next batch, whatever their times. Both the merged rows and the new state of batch n are written to
    places that depend on n alone, so a batch that runs again after a failure leaves the same result. Two slots take turns
    for the state. Topics not seen for ``ttl`` seconds before the newest tick are forgotten; their next tick starts anew.
    """

    def __init__(self, fields: list[str], at: str, ttl: float | None = None, segments: int | None = None) -> None:
        self.fields, self.at, self.ttl, self.segments = fields, at, ttl, segments

    def _slot(self, spark: SparkSession, slot: int) -> tuple[int, DataFrame] | None:
        try:
            rows = spark.read.parquet(f"{self.at}/state/{slot}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.agg(F.max("batch")).first()[0] or 0, rows

    def state(self, spark: SparkSession, before: int) -> DataFrame | None:
        """(topic, seen, fields) after the last batch below ``before``."""
        have = [x for x in (self._slot(spark, 0), self._slot(spark, 1)) if x is not None and x[0] < before]
        return max(have, key=lambda x: x[0])[1].filter("topic IS NOT NULL OR seen IS NOT NULL") if have else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("topic", "ts", "seq", *[F.col(f).cast("double").alias(f) for f in self.fields], F.lit(False).alias("_old"))
        known = self.state(spark, batch_id)
        first = F.lit("1901-01-01").cast("timestamp")  # before any tick
        if known is not None:
            rows = rows.unionByName(known.select("topic", first.alias("ts"), F.lit(-1).cast("long").alias("seq"), *self.fields, F.lit(True).alias("_old")))
        rows = written(rows)
        merged = merge_deltas(rows.drop("_old"), self.fields, self.segments).filter(F.col("ts") > first)
        merged.write.mode("overwrite").parquet(f"{self.at}/rows/batch={batch_id}")
        order = F.struct(~F.col("_old"), "ts", "seq")
        said = lambda f: F.col(f).isNotNull() & (F.col(f) != KEEP)
        last = rows.groupBy("topic").agg(
            F.max(F.when(~F.col("_old"), F.col("ts"))).alias("now"), *[F.max_by(f, F.when(said(f), order)).alias(f) for f in self.fields]
        )
        if known is not None:
            last = last.join(known.select("topic", "seen"), "topic", "left").withColumn("seen", F.greatest("now", "seen"))
        else:
            last = last.withColumn("seen", F.col("now"))
        new = last.select("topic", "seen", *self.fields, F.lit(batch_id).cast("long").alias("batch"))
        if self.ttl is not None:
            limit = new.agg(F.max("seen")).first()[0]
            if limit is not None:
                new = new.filter(F.col("seen") >= F.lit(limit) - F.expr(f"INTERVAL {self.ttl} SECONDS"))
        new.write.mode("overwrite").parquet(f"{self.at}/state/{batch_id % 2}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All merged rows so far."""
        schema = "topic string, ts timestamp, seq long, " + ", ".join(f"{f} double" for f in self.fields)
        return spark.read.schema(schema).parquet(f"{self.at}/rows/*")


def merge_deltas_stream(t: DataFrame, fields: list[str]) -> DataFrame:
    """Streaming form of :func:`merge_deltas`: the state of a topic is its last value of each field."""
    schema = "topic string, ts timestamp, seq long, " + ", ".join(f"{f} double" for f in fields)
    state_schema = ", ".join(f"{f} double" for f in fields)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else [None] * len(fields)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        vals = rows[fields].astype(float)
        vals = vals.where(vals != KEEP)
        first = pd.DataFrame([last], columns=fields, dtype=float)
        full = pd.concat([first, vals], ignore_index=True).ffill()
        prev, now = full.iloc[:-1].reset_index(drop=True), full.iloc[1:].reset_index(drop=True)
        changed = ((prev != now) & ~(prev.isna() & now.isna())).any(axis=1)
        state.update(tuple(None if pd.isna(v) else float(v) for v in full.iloc[-1]))
        out = pd.concat([rows[["topic", "ts", "seq"]].reset_index(drop=True), now], axis=1)
        yield out[changed]

    return t.groupBy("topic").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def drop_repeats(t: DataFrame, price: str = "price") -> DataFrame:
    """Drop a tick that repeats the price of the tick before it within the same whole second.

    Only ticks of one second are compared, so the window is (symbol, second).
    """
    w = W.partitionBy("symbol", "_sec").orderBy("ts", "seq")
    x = t.withColumn("_sec", F.date_trunc("second", "ts"))
    return x.withColumn("_p", F.lag(price).over(w)).filter(~truth(F.col(price) == F.col("_p"))).drop("_sec", "_p")


def drop_repeats_stream(t: DataFrame, price: str = "price", delay: str = "10 seconds") -> DataFrame:
    """Streaming form of :func:`drop_repeats`: a tick goes if the tick before it in its symbol's second has its price.

    The state of a (symbol, second) is its last tick; it goes once the watermark has passed the second by ``delay``, and
    the ticks of one second are all that a task holds.
    """
    x = t.withColumn("_sec", F.date_trunc("second", "ts")).withWatermark("_sec", delay)
    names = t.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema.fields)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        before = rows[price].shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        last = rows[price].iloc[-1]
        state.update((None if pd.isna(last) else float(last),))
        state.setTimeoutTimestamp(int(pd.Timestamp(key[1]).timestamp() * 1000) + 1000)
        yield rows[~(rows[price] == before)][names]

    return x.groupBy("symbol", "_sec").applyInPandasWithState(step, schema, "price double", "append", GroupStateTimeout.EventTimeTimeout)


def topic_key(exchange: Column, symbol: Column, mode: Column) -> Column:
    """EXCH_SYM_MODE, the key of the message sink."""
    return F.concat_ws("_", exchange, symbol, mode)


def tick_bars(t: DataFrame, every: str, delay: str = "10 minutes") -> DataFrame:
    """Ticks to OHLCV bars; on a stream, ticks later than ``delay`` are dropped and a bar appears once its window is closed."""
    if t.isStreaming:
        t = t.withWatermark("ts", delay)
    return intraday_bars(t, every)
