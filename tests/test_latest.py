"""What only the last bar needs is an aggregate over bars by age: same values, no wide rows in the windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import ts
from tickloom.operators import indicators, portfolio, reports, strategies
from tickloom.operators.snapshot import snapshot


def bars(spark, lengths):
    rng, rows = random.Random(4), []
    for s, n in enumerate(lengths):
        px = 50.0 + 20 * s
        for i in range(n):
            o, px = px, max(1.0, px * (1 + rng.uniform(-0.04, 0.04)))
            hi, lo = max(o, px) * (1 + rng.random() / 50), min(o, px) * (1 - rng.random() / 50)
            rows.append((f"S{s}", dt.date(2015, 1, 1) + dt.timedelta(i), o, hi, lo, px, float(rng.randint(1, 999))))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def windows_of(df):
    out, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "Window":
            out.append(p.output().size())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_last_bar_equals_the_panel(spark):
    b = bars(spark, (1, 2, 13, 14, 20, 34, 56, 101, 200, 253, 600))
    want = strategies.candles(indicators.indicators(b).drop("bn", "n_bars"))
    want = {r["symbol"]: r for r in ts.latest(want).collect()}
    s = strategies.candle_aggs()
    p = indicators.latest_columns(b)
    c = p.groupBy("symbol").agg(indicators.last_row(["open", "high", "low", "close", "bn"]).alias("_l"), *[v.alias(k) for k, v in s.items()])
    candle = {r["symbol"]: r["candle_pattern"] for r in strategies.candle_latest(c.select("symbol", "_l.*", *s)).collect()}
    got = indicators.latest_indicators(b)
    names = [x for x in got.columns if not x.startswith("_") and x in ts.latest(indicators.indicators(b)).columns]
    assert set(names) >= {"sma_200", "ema_200", "prev_high_55", "prev_sma_100", "cci_14", "z_score", "bb_upper", "macd_hist", "adx_14"}
    rows = got.collect()
    assert len(rows) == len(want) == 11
    for r in rows:
        w = want[r["symbol"]]
        assert candle[r["symbol"]] == w["candle_pattern"]
        for x in names:
            if isinstance(w[x], float):
                assert r[x] == pytest.approx(w[x], rel=1e-9, abs=1e-9), (r["symbol"], x)
            else:
                assert r[x] == w[x], (r["symbol"], x)


def test_snapshot_windows_are_narrow(spark):
    widths = windows_of(snapshot(bars(spark, (30,))).select("symbol", "vcp_action", "trend_status", "knn_action"))
    assert max(widths) <= 50 and sum(widths) <= 400


def nodes(df, name):
    found, todo = 0, [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        found += p.nodeName() == name
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_grouped_bars_need_no_grouping(spark):
    t = strategies.bar_strategies(indicators.indicators(bars(spark, (3, 230, 300)))).withColumn("traded_value", F.col("close") * F.col("volume"))
    want = reports.grouped_view(reports.strategy_rows(t), ("symbol", "date"))
    got = reports.grouped_bars(t)
    assert got.columns == want.columns and nodes(got, "Aggregate") == 0
    rows = sorted(tuple(r) for r in got.collect())
    assert rows and rows == sorted(tuple(r) for r in want.collect())


def test_rules_share_their_windows(spark):
    b = bars(spark, (40, 60))
    rules = {"a": (F.col("close") > F.col("open"), F.col("close") < 50), "b": (F.col("close") < 52, F.col("close") > 48), "c": (F.col("volume") > 500, F.lit(None) > 0)}
    got = portfolio.rule_positions(b, rules)
    assert nodes(got, "Window") == 2
    entry = {"a": lambda r: r.close > r.open, "b": lambda r: r.close < 52, "c": lambda r: r.volume > 500}
    leave = {"a": lambda r: r.close < 50, "b": lambda r: r.close > 48, "c": lambda r: False}
    now, symbol = {}, None
    for r in got.orderBy("symbol", "date").collect():
        if r.symbol != symbol:
            now, symbol = dict.fromkeys(rules, 0), r.symbol
        for k in rules:
            now[k] = int(entry[k](r)) if now[k] == 0 else int(not leave[k](r))
            assert r[k] == now[k], (r.symbol, r.date, k)


def test_block_sort_is_narrow(spark):
    """The sort by blocks holds prices, bar number and block, no lagged or derived column."""
    b = indicators.recursive(bars(spark, (30,)).select("symbol", "date", "high", "low", "close")).select("symbol", "date", "adx_14")
    widths, plan = [], [b._jdf.queryExecution().optimizedPlan()]
    while plan:
        p = plan.pop()
        if p.nodeName() == "Window" and "_blk" in p.toString().split("\n")[0]:
            out = p.children().apply(0).output()
            widths.append(sorted(out.apply(i).name() for i in range(out.size()) if out.apply(i).name().startswith("_")))
        plan += [p.children().apply(i) for i in range(p.children().size())]
    assert ["_blk"] in widths
