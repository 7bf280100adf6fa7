"""Scanners on one panel, and the partial forms of reports and features."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ts
from tickloom.functions.num import c
from tickloom.operators import indicators as ind
from tickloom.operators import learn, registry, reports, scanners, strategies

BAR = "symbol string, date date, open double, high double, low double, close double, volume double, turnover double"
D0 = dt.date(2021, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = random.Random(3), []
    for s in range(12):
        px = 50.0 + s
        for i in range(300):
            px *= 1 + r.gauss(0.001 * (s - 5), 0.02)
            v = float(r.randrange(1, 1000))
            rows.append((f"S{s}", D0 + dt.timedelta(days=i), px, px * 1.01, px * 0.99, px, v, v * px))
    return spark.createDataFrame(rows, BAR).cache()


def keys(df):
    return sorted((r.symbol, r.strategy_name, r.action, round(r.conviction, 6), r.timestamp) for r in df.collect())


def test_a_shared_panel_gives_each_scanner_its_own_signals(spark, bars):
    chosen = {"rsi_scanner": registry.oversold(60.0), "darvas_box": registry.boxes(recent=200), "momentum_squeeze": registry.squeezes()}
    got = registry.scan(bars, chosen=chosen)
    snap = ts.latest(ind.recursive(bars.withColumn("prev_close", ts.lag(c.close))))
    one = [(r.symbol, "rsi_scanner", 1, round(r.conviction, 6)) for r in scanners.rsi_scan(snap, entry=60.0).collect()]
    dv = ts.tail(scanners.darvas(bars), 200).filter(c.darvas_signal.startswith("Break")).collect()
    one += [(r.symbol, "darvas_box", 1 if r.darvas_signal.startswith("Breakout") else -1, r.conviction) for r in dv]
    one += [(r.symbol, "momentum_squeeze", r.action, r.conviction) for r in scanners.squeeze_signals(scanners.momentum_squeeze(bars)).collect()]
    assert sorted((s, n, a, v) for s, n, a, v, _ in keys(got)) == sorted(one)
    assert {"rsi_scanner", "darvas_box", "momentum_squeeze"} == {r.strategy_name for r in got.select("strategy_name").distinct().collect()}


def test_six_scanners_share_one_shuffle_of_the_bars(spark, bars):
    p = registry.panel_hits(bars, registry.REGISTRY)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning(symbol") == 1, p


def test_scanners_across_symbols(spark, bars):
    master = spark.createDataFrame([(f"S{i}", "odd" if i % 2 else "even") for i in range(12)] + [("GONE", "odd")], "symbol string, category string")
    got = registry.scan(bars, master, {"liquid_funds": registry.liquid_funds(), "trend_leaders": registry.leaders(min_rs=0.0, min_template=0, min_proximity=0.0, min_rvol=0.0), "pair_scanner": registry.pair_trades(100, 0.5, max_p=0.5)})
    by = {}
    for r in got.collect():
        by.setdefault(r.strategy_name, []).append(r)
    last = {r.symbol: r.turnover for r in ts.latest(bars).collect()}
    want = {max((s for s in last if int(s[1:]) % 2 == k), key=lambda s: last[s]) for k in (0, 1)}
    assert {r.symbol for r in by["liquid_funds"]} == want and max(r.conviction for r in by["liquid_funds"]) == 1.0
    assert {r.meta["rs_rating"] for r in by["trend_leaders"]} and len(by["pair_scanner"]) % 2 == 0
    ids = [r.meta["pair_id"] for r in by["pair_scanner"]]
    assert all(ids.count(i) == 2 for i in ids)


def test_register_refuses_a_second_scanner_of_a_name():
    with pytest.raises(ValueError, match="duplicate"):
        registry.register("darvas_box", registry.boxes())
    assert len(registry.REGISTRY) == 6


def test_no_bars_no_signals(spark, bars):
    master = spark.createDataFrame([("S1", "x")], "symbol string, category string")
    assert registry.scan(bars.limit(0), master).count() == 0


def test_top_of_kinds_is_one_scan_with_a_limit_before_the_shuffle(spark, bars):
    t = ts.latest(bars.withColumn("prev", ts.lag(c.close))).select("symbol", "turnover", "volume", (c.close / c.prev - 1).alias("change_pct"), F.lit("i").alias("index_name"))
    m = reports.movers(t.cache(), 3)
    p = m._jdf.queryExecution().executedPlan().toString()
    assert p.count("WindowGroupLimit") == 2 and p.count("Exchange hashpartitioning(index_name") == 1
    rows = {(r.kind, r["rank"]): (r.symbol, r.value) for r in m.collect()}
    want = sorted(((r.change_pct, r.symbol) for r in t.collect()), reverse=True)
    assert [rows["gainer", k + 1][0] for k in range(3)] == [s for _, s in want[:3]]
    assert [rows["loser", k + 1][0] for k in range(3)] == [s for _, s in want[::-1][:3]]


def test_difference_column_is_that_of_the_strategy_that_has_one(spark, bars):
    rows = reports.strategy_rows(strategies.bar_strategies(ind.indicators(bars)))
    some = rows.filter(c.diff_pct.isNotNull())
    assert [r.strategy for r in some.select("strategy").distinct().collect()] == ["dma20"]
    g = reports.grouped_view(rows, ("symbol", "date"))
    have = {(r.symbol, r.date): r.diff_pct for r in some.collect()}
    assert {(r.symbol, r.date): r.diff_pct for r in g.filter(c.diff_pct.isNotNull()).collect()} == have


def test_macd_fallback_is_the_unadjusted_exponential_mean(spark, bars):
    got = {r.date: r.macd_hist for r in learn.feature_table(bars).filter("symbol = 'S3'").collect()}
    x = pd.Series({r.date: r.close for r in bars.filter("symbol = 'S3'").collect()}).sort_index()
    m = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    want = m - m.ewm(span=9, adjust=False).mean()
    assert len(got) > 250 and all(abs(v - want[d]) < 1e-9 for d, v in got.items())
