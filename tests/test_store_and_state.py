"""Bars stored in buckets, and indicators carried forward day by day."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import ts
from tickloom.operators import incremental as inc
from tickloom.operators import indicators as ind
from tickloom.operators import risk, trend
from tickloom.plans.q_state import _until
from tickloom.sources import barstore
from tickloom.sources import bars as B

SF = "/root/testdata/sf0.001"
BAR = "symbol string, date date, open double, high double, low double, close double, volume double"
D0 = dt.date(2020, 1, 1)


def walk(symbol, n, seed, flat=0):
    """n bars of a random walk; the first ``flat`` ones do not move."""
    r, px, rows = random.Random(seed), 100.0, []
    for i in range(n):
        px = px if i < flat else max(1.0, px * (1 + r.gauss(0, 0.02)))
        spread = 0.0 if i < flat else r.random()
        rows.append((symbol, D0 + dt.timedelta(days=i), px, px + spread, px - spread, px + spread / 2 if i >= flat else px, float(r.randrange(1000))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return walk("A", 300, 1) + walk("B", 40, 2, flat=20) + walk("C", 15, 3) + walk("D", 1, 4) + walk("E", 600, 5)


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None and y is None) or x == y or abs(x - y) < 1e-6 * max(1.0, abs(y)), (k, x, y)


def last_rows(df, cols):
    return {r.symbol: tuple(r[c] for c in cols if c != "date") for r in df.select("symbol", *cols).collect()}


@pytest.mark.parametrize("cuts", [(0,), (1, 2, 13, 14, 15, 26, 34), (30, 260, 299), (599,)])
def test_state_and_days_equal_the_full_computation(spark, rows, cuts):
    bars = spark.createDataFrame(rows, BAR)
    state, done = inc.build_state(bars.filter(F.col("date") < D0)), D0
    for k in (*cuts, 600):
        upto = D0 + dt.timedelta(days=k)
        new = bars.filter((F.col("date") >= done) & (F.col("date") < upto))
        state, done = inc.update_state(state, new).cache(), upto
    got = inc.panel_row(state)
    full = ts.latest(ind.indicators(bars))
    cols = [x for x in got.columns if x in full.columns and x not in ("symbol",)]
    assert len(cols) >= 38
    same(last_rows(got, cols), last_rows(full, cols))


def test_built_state_goes_on_like_a_folded_one(spark, rows):
    bars = spark.createDataFrame(rows, BAR)
    cut = D0 + dt.timedelta(days=37)
    a = inc.update_state(inc.build_state(bars.filter(F.col("date") <= cut)), bars.filter(F.col("date") > cut))
    b = inc.update_state(inc.build_state(bars.limit(0)), bars)
    cols = [x for x in inc.panel_row(a).columns if x not in ("symbol", "date")]
    same(last_rows(inc.panel_row(a), cols), last_rows(inc.panel_row(b), cols))


def test_late_and_broken_bars_change_nothing(spark):
    bars = spark.createDataFrame(walk("A", 60, 1), BAR)
    state = inc.build_state(bars).cache()
    again = bars.filter(F.col("date") >= D0 + dt.timedelta(days=50))
    broken = spark.createDataFrame([("A", D0 + dt.timedelta(days=80), None, 1.0, 1.0, 1.0, 1.0), ("N", D0, 1.0, None, 1.0, 1.0, 1.0)], BAR)
    after = inc.update_state(state, again.union(broken))
    assert sorted(map(str, after.collect())) == sorted(map(str, state.collect()))
    assert inc.late_bars(state, again).count() == 10


def test_a_day_reads_its_own_trades(spark):
    history, new = _until(spark, SF, 1)
    state = inc.build_state(history.limit(50))
    plan = inc.panel_row(inc.update_state(state, new))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" in plan and plan.count("Window") <= inc.build_state(history.limit(50))._jdf.queryExecution().optimizedPlan().toString().count("Window")
    scans = new._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scans and scans.count("Window") == 0


@pytest.fixture(scope="module")
def store(spark, rows):
    return barstore.store_bars(spark.createDataFrame(rows, BAR).repartition(6), 4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_on_the_store_need_no_exchange_and_no_sort(store):
    b = store.by_symbol()
    for df in (ind.sma(b), risk.risk_table(b), trend.trend_status(ts.latest(ind.sma(b)))):
        assert "Exchange" not in plan(df) and "Sort " not in plan(df), plan(df)


def test_store_gives_back_its_bars(spark, store, rows):
    assert sorted(map(tuple, store.by_symbol().collect())) == sorted(rows)
    got = store.by_day("2020-02-15", "2020-03-03").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if dt.date(2020, 2, 15) <= r[1] <= dt.date(2020, 3, 3))


def test_a_range_of_days_reads_its_months(store):
    months = {f.split("month=")[1][:7] for f in store.by_day("2020-02-15", "2020-03-03").inputFiles()}
    assert months == {"2020-02", "2020-03"}
    p = plan(store.by_day("2020-02-15", "2020-03-03"))
    assert "PartitionFilters: [" in p and "month" in p.split("PartitionFilters: [")[1].split("]")[0]


def test_append_replaces_days_and_keeps_the_rest(spark, store, rows):
    new = [("A", D0 + dt.timedelta(days=299), 1.0, 2.0, 0.5, 1.5, 9.0), ("A", D0 + dt.timedelta(days=300), 1.0, 2.0, 0.5, 1.6, 9.0), ("Z", D0, 1.0, 2.0, 0.5, 1.7, 9.0), ("Z", D0, 1.0, 2.0, 0.5, 1.7, 9.0)]
    after = store.append(spark.createDataFrame(new, BAR))
    want = {(r[0], r[1]): r for r in rows} | {(r[0], r[1]): r for r in new}
    for df in (after.by_symbol(), after.by_day()):
        assert sorted(map(tuple, df.collect())) == sorted(want.values())
    assert "Exchange" not in plan(ind.sma(after.by_symbol())) and "Sort " not in plan(ind.sma(after.by_symbol()))
    assert sorted(map(tuple, store.by_symbol().collect())) == sorted(rows)  # the generation before is as it was


def test_prices_of_the_store_agree(store):
    assert B.prices(store.by_symbol(), "b", "2020-01-05", "2020-01-08").count() == B.prices(store.by_day(), "b", "2020-01-05", "2020-01-08").count() == 4
