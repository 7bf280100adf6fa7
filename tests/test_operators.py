"""Literal expectations and independent recurrences on small frames."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import rank, recur, ts
from tickloom.functions.rolling import rolling
from tickloom.operators import anomaly, cointegration, consensus, indicators, pairs, portfolio, quality, reports, risk, scanners, strategies, trend
from tickloom.sources import bars as B
from tickloom.sources import files
from tickloom.streaming import ticks as tk

D0 = dt.date(2020, 1, 1)


def frame(spark, closes, symbol="A", highs=None, lows=None, opens=None, volumes=None):
    n = len(closes)
    rows = [
        (symbol, D0 + dt.timedelta(days=i), float((opens or closes)[i]), float((highs or closes)[i]), float((lows or closes)[i]), float(closes[i]), float((volumes or [1000] * n)[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


def test_smoothing_crosses_blocks(spark):
    """EMA and ADX inputs over more than three blocks equal the plain recurrence."""
    rng = random.Random(1)
    px = [100.0]
    for _ in range(1699):
        px.append(max(1.0, px[-1] * (1 + rng.uniform(-0.05, 0.05))))
    assert len(px) > 3 * recur.BLOCK
    got = column(indicators.recursive(frame(spark, px), ema=(20, 200)), "ema_200")
    y, want = None, []
    for i, x in enumerate(px):
        y = None if i < 199 else sum(px[:200]) / 200 if i == 199 else y + 2 / 201 * (x - y)
        want.append(y)
    assert got[:199] == [None] * 199
    assert np.allclose(got[199:], want[199:], rtol=1e-11)


def test_rsi_recurrence(spark):
    rng = random.Random(2)
    px = [50 + 10 * rng.random() for _ in range(700)]
    got = column(indicators.recursive(frame(spark, px)), "rsi_14")
    g = d = 0.0
    for i in range(1, len(px)):
        ch = px[i] - px[i - 1]
        u, v = max(ch, 0), max(-ch, 0)
        if i <= 14:
            g, d = g + u / 14, d + v / 14
        else:
            g, d = (g * 13 + u) / 14, (d * 13 + v) / 14
        if i >= 14:
            assert math.isclose(got[i], 100 * g / (g + d), rel_tol=1e-9)
    assert got[13] is None


def test_rolling_equals_plain_windows(spark):
    rng = random.Random(3)
    px = [rng.uniform(1, 100) for _ in range(300)]
    b = frame(spark, px)
    specs = {f"{op}{n}": (op, "close", n) for op in ("sum", "min", "max", "mean") for n in (2, 5, 20, 55, 126, 200, 252)}
    got = rolling(b, specs).orderBy("date").toPandas()
    plain = {"sum": lambda r: r.sum(), "mean": lambda r: r.mean(), "min": lambda r: r.min(), "max": lambda r: r.max()}
    for k, (op, _, n) in specs.items():
        want = plain[op](got["close"].rolling(n))
        assert np.allclose(got[k].astype(float), want, equal_nan=True), k


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", -3.0), ("d", None), ("e", 100.0)], "symbol string, v double")
    r = {x.symbol: (x.rank, x.pct) for x in rank.percent_rank_avg(rank.min_rank(df, "v"), "v", "pct").collect()}
    assert r == {"e": (1, 100.0), "a": (2, 62.5), "b": (2, 62.5), "c": (4, 25.0), "d": (None, None)}


def test_drawdown_and_calmar(spark):
    r = risk.risk_table(frame(spark, [100, 120, 90, 110, 80, 130])).first()
    assert math.isclose(r.max_drawdown_pct, -100 / 3, rel_tol=1e-9)
    assert risk.risk_table(frame(spark, [100 * 1.001**i for i in range(260)])).first().calmar_1y is None
    assert risk.risk_table(frame(spark, [100, 105, 95, 102, 90, 110])).first().calmar_1y is not None


def test_beta_sign_and_short_history(spark):
    rng = np.random.default_rng(42)
    bench = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 150)))
    stock = 1.2 * bench + rng.normal(0, 0.5, 150)
    b = frame(spark, list(bench)).select("date", F.col("close").alias("bench"))
    assert risk.beta(frame(spark, list(stock)), b).first().beta > 0
    assert risk.beta(frame(spark, list(stock[:10])), b).first().beta is None


@pytest.mark.parametrize("closes,label", [([10 + 5 * i for i in range(15)], "Buy/Average Out"), ([100] * 15, "Avoid/Hold")])
def test_car_rating(spark, closes, label):
    assert trend.car_rating(frame(spark, closes, highs=[150] + [100] * 14)).first().car_rating == label


@pytest.mark.parametrize(
    "last_low,last_close,status,advice",
    [(101, 105, "Do not start GTT", None), (100.2, 100.2, "Do not start GTT", "No bounce"), (100.2, 100.5, "Start GTT (Basic)", None), (100.2, 101.5, "Start GTT", "Bounce: 1.50%")],
)
def test_bottom_out(spark, last_low, last_close, status, advice):
    lows, closes = [100.0] * 19 + [last_low], [120.0] * 19 + [last_close]
    r = ts.latest(trend.bottom_out(frame(spark, closes, highs=[150] * 20, lows=lows))).first()
    assert r.bottom_out_status == status and (advice is None or advice in r.swing_advice)


def test_circuit(spark):
    r = ts.latest(trend.circuit(frame(spark, [1000] * 199 + [1200]))).first()
    assert r.circuit_type == "UC (20%)" and r.circuit_locked


def test_darvas_breakout(spark):
    closes, vols = [100] * 25 + [110], [500_000] * 25 + [1_500_000]
    r = ts.latest(scanners.darvas(frame(spark, closes, highs=[101] * 25 + [111], lows=[99] * 25 + [109], volumes=vols))).first()
    assert r.darvas_signal == "Breakout (Volume Confirmed)" and r.vol_confirmed


def test_short_history_has_no_vcp(spark):
    r = strategies.vcp(indicators.sma(frame(spark, [100] * 60, highs=[101] * 60, lows=[99] * 60), (50, 200))).first()
    assert r.vcp_action == "No VCP" and r.vcp_reason == "Insufficient data (60 < 250)"


def test_supertrend_long_entry(spark):
    px = [100 - i * 0.5 for i in range(40)] + [140]
    r = strategies.dual_supertrend(frame(spark, px, highs=[p + 1 for p in px], lows=[p - 1 for p in px])).first()
    assert r.supertrend_action == "Long Entry"
    assert strategies.dual_supertrend(frame(spark, px[:5])).first().supertrend_action == "Insufficient Data"


def test_consensus_scores(spark):
    hold = {v: "Hold" for v in strategies.VOTERS}
    nine = {**hold, **{v: "Breakout Buy" for v in strategies.VOTERS[:9]}}
    two = {**hold, "rdx": "Explosive Sell", "knn": "Lorentzian Sell"}
    rows = [(s, *[x[v] for v in strategies.VOTERS]) for s, x in (("A", nine), ("B", hold), ("C", two))]
    df = spark.createDataFrame(rows, ["symbol", *[f"{v}_action" for v in strategies.VOTERS]])
    got = {r.symbol: r for r in consensus.weighted(consensus.vote(df)).collect()}
    assert [got[s].consensus_score for s in "ABC"] == [9, 0, -2]
    assert got["B"].portfolio_action == "NEUTRAL / SIDEWAYS" and got["B"].confidence_pct == 50.0


def test_signal_mean(spark):
    s = spark.createDataFrame([("R", 1, 0.8), ("R", 1, 0.6), ("R", 0, 0.5)], "symbol string, action int, conviction double")
    assert math.isclose(consensus.consensus_mean(s).first().score, 1.4 / 3)


def test_costs_and_size(spark):
    df = spark.createDataFrame([(100.0, 10.0, "BUY"), (100.0, 10.0, "SELL")], "p double, q double, s string")
    buy, sell = [r.c for r in df.select(portfolio.trade_cost(F.col("p"), F.col("q"), F.col("s")).alias("c")).collect()]
    assert buy > sell > 1
    r = portfolio.position_size(spark.createDataFrame([("A", 250.0, 8.5)], "symbol string, close double, atr_14 double")).first()
    assert (r.suggested_qty, r.stop_price, r.risk_amount) == (392.0, 237.25, 5000.0)


def test_rule_position_with_both_conditions(spark):
    ev = [(0, 0), (1, 0), (1, 1), (0, 0), (1, 1), (1, 1), (0, 1), (1, 0)]
    b = frame(spark, list(range(1, 9))).withColumn("k", F.datediff("date", F.lit(D0)))
    e = F.array(*[F.lit(bool(x)) for x, _ in ev])
    x = F.array(*[F.lit(bool(y)) for _, y in ev])
    got = column(portfolio.rule_position(b, F.get(e, "k"), F.get(x, "k")), "position")
    p, want = 0, []
    for a, z in ev:
        p = 1 if p == 0 and a else 0 if p == 1 and z else p
        want.append(p)
    assert got == want


def test_split_adjustment(spark):
    old = frame(spark, [200] * 20)
    new = frame(spark, [100] * 21).filter(F.col("date") >= D0 + dt.timedelta(days=19))
    r = quality.back_adjust(old, new).filter(F.col("date") == D0 + dt.timedelta(days=18)).first()
    assert (r.close, r.volume) == (100.0, 2000.0)


def test_gate_labels(spark):
    rng = np.random.default_rng(42)
    px = list(100 * np.exp(np.cumsum(rng.normal(0, 0.005, 100))))
    last = lambda f: ts.latest(quality.bar_gate(frame(spark, px + [px[-1] * f]))).first().verdict
    assert (last(1.001), last(1.5), last(0.5)) == ("OK", "BAD_TICK", "CORP_ACTION")


def test_step_hint_and_averaging(spark):
    hints = spark.createDataFrame([(28.5,), (4.0,), (34.0,), (None,)], "r double").select(scanners.step_hint(F.col("r")).alias("h"))
    assert [r.h for r in hints.collect()] == ["Step 2 (Average < 30)", "Step 7 (Average < 5)", "Step 1 (Entry < 35)", "Unknown"]
    h = spark.createDataFrame([("A", 612.5, 1)], "symbol string, last_buy_price double, last_step int")
    s = spark.createDataFrame([("A", 580.0, 28.5)], "symbol string, close double, rsi_14 double")
    r = scanners.averaging(h, s).first()
    assert r.eligible and r.next_step == 2


def test_cointegration(spark):
    rng = np.random.default_rng(42)
    walk = np.cumsum(rng.normal(0, 1, 300)) + 200
    other = np.cumsum(rng.normal(0, 1, 300)) + 300
    assert cointegration.engle_granger((walk + rng.normal(0, 0.5, 300))[None], walk[None])[0] < 0.01
    b = frame(spark, list(walk), "A").union(frame(spark, list(walk + rng.normal(0, 0.5, 300)), "B")).union(frame(spark, list(other), "C"))
    got = {(r.symbol_a, r.symbol_b): r.p_value for r in cointegration.cointegrated_pairs(b, max_p=1.0, per_block=1).collect()}
    one = {(r.symbol_a, r.symbol_b): r.p_value for r in cointegration.cointegrated_pairs(b, max_p=1.0).collect()}
    assert set(got) == {("A", "B"), ("A", "C"), ("B", "C")} and got == pytest.approx(one) and got[("A", "B")] < 0.01


def test_anomalies_find_the_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))] + [(999, 25.0, -25.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    assert anomaly.isolation_anomalies(df, ["a", "b"], trees=30).first().id == 999


def test_vol_regime_tracks_volatility(spark):
    rng = np.random.default_rng(5)
    calm = list(100 * np.exp(np.cumsum(rng.normal(0, 0.004, 300))))
    wild = list(100 * np.exp(np.cumsum(rng.normal(0, 0.04, 300))))
    got = {r.symbol: r for r in risk.vol_regime(frame(spark, calm, "C").union(frame(spark, wild, "W"))).collect()}
    assert got["C"].vol_regime == "Low" and got["W"].vol_regime == "High"
    assert risk.vol_regime(frame(spark, calm[:40])).first().vol_regime == "Unknown"


def test_indicator_parity(spark):
    rng = random.Random(9)
    px = [100 + rng.uniform(-5, 5) for _ in range(600)]
    r = quality.parity(indicators.recursive(indicators.sma(frame(spark, px, highs=[p + 1 for p in px], lows=[p - 2 for p in px]), (50,)))).first()
    assert max(r.asDict().values()) < 1e-8


def test_daily_file_generations(spark):
    a = spark.createDataFrame([("X", "EQ", "10", "2.5"), ("Y", "BE", "9", "1"), ("Z", "EQ", "8", "-")], ["SYMBOL", " SERIES", "CLOSE", "TURNOVER_LACS"])
    assert [tuple(r) for r in files.normalise_daily(a).collect()] == [("X", 250000.0, 10.0, None, None)]
    b = spark.createDataFrame([("X", "EQ", "10", "2.5")], ["TckrSymb", "SctySrs", "ClsPric", "TtlTrfVal"])
    assert files.normalise_daily(b).first().turnover == 2.5
    with pytest.raises(ValueError):
        files.normalise_daily(b.drop("ClsPric"))


def test_symbol_forms(spark):
    df = spark.createDataFrame([(" nse:TCS-EQ ",), ("INFY.NS",)], "s string")
    assert [r.b for r in df.select(files.normalise_symbol(F.col("s")).alias("b")).collect()] == ["TCS", "INFY"]


def test_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5)], "symbol string, v double")
    files.save(df, str(tmp_path / "p"))
    files.save(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.parquet(str(tmp_path / "p")).first().v == 1.5
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().symbol == "A"


def test_prices_and_latest(spark):
    a = frame(spark, [100, 101, 102], "MOCKA").unionByName(frame(spark, [200, 201], "MOCKB"))
    assert B.prices(a, symbol=" mocka ").count() == 3
    assert B.prices(a, symbol="MOCKA", start="2020-01-02", end="2020-01-02").first().close == 101.0
    assert {r.symbol: r.close for r in B.latest_bars(a).collect()} == {"MOCKA": 102.0, "MOCKB": 201.0}
    assert B.sql_over_prices(a, "SELECT count(*) AS n FROM prices WHERE symbol = :s", {"s": "MOCKB"}).first().n == 2


def _deltas(spark):
    rng = random.Random(4)
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for i in range(400):  # one topic holds most ticks
        topic = "HOT" if rng.random() < 0.8 else f"T{rng.randrange(4)}"
        ltp = float(rng.randrange(3)) if rng.random() < 0.6 else None if rng.random() < 0.5 else float(tk.KEEP)
        rows.append((topic, t0 + dt.timedelta(minutes=17 * i), i, ltp, float(rng.randrange(2)) if rng.random() < 0.5 else None))
    return spark.createDataFrame(rows, "topic string, ts timestamp, seq long, ltp double, volume double")


def test_delta_merge_batch_equals_stream(spark, tmp_path):
    d = _deltas(spark)
    want = sorted(tuple(r) for r in tk.merge_deltas(d, ["ltp", "volume"]).select("topic", "seq", "ltp", "volume").collect())
    for lo, hi in ((0, 150), (150, 400)):
        d.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tk.merge_deltas_stream(s, ["ltp", "volume"]).writeStream.format("memory").queryName("deltas_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT topic, seq, ltp, volume FROM deltas_out").collect())
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_tick_bars_batch_equals_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A" if i % 3 else "B", t0 + dt.timedelta(seconds=20 * i), i, float(i % 7)) for i in range(300)]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double")
    want = sorted(tuple(r) for r in tk.tick_bars(t, "5 minutes").collect())
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = tk.tick_bars(s, "5 minutes").writeStream.format("memory").outputMode("complete").queryName("bars_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("bars_out").collect()) == want


def test_repeats(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", t0 + dt.timedelta(milliseconds=m), i, p) for i, (m, p) in enumerate([(0, 1.0), (50, 1.0), (90, 2.0), (1100, 2.0), (1200, 2.0)])]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double")
    assert sorted(r.seq for r in tk.drop_repeats(t).collect()) == [0, 2, 3]


def test_pair_helpers(spark):
    a, b = frame(spark, [1, 2, 4], "A"), frame(spark, [2, 4, 8], "B")
    assert pairs.aligned_pairs(a.union(b), ["A", "B"]).count() == 3
    m = {(r.symbol_a, r.symbol_b): r["corr"] for r in risk.correlation_matrix(frame(spark, [1, 2, 3, 7], "A").union(frame(spark, [2, 4, 6, 14], "B")), ["A", "B"]).collect()}
    assert math.isclose(m[("A", "B")], 1.0) and m[("A", "A")] == 1.0


def test_net_position_default(spark):
    p = spark.createDataFrame([("A", "MIS", 5, 1), ("A", "MIS", 9, 2)], "symbol string, product string, net_qty long, row_no int")
    assert reports.net_position(p, "A", "MIS").first().net_qty == "5"
    assert reports.net_position(p, "B", "MIS").first().net_qty == "0"


def test_anomalies_read_their_rows_once(spark, monkeypatch):
    """Bars are aggregated for one written table, no lambda is evaluated for each row and tree, and the paths are those of a walk down each tree."""
    seen, write = [], anomaly.written
    monkeypatch.setattr(anomaly, "written", lambda df: seen.append(df) or write(df))
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(0, 1, (700, 2)))], "id int, a double, b double")
    monkeypatch.setattr(anomaly.F, "filter", None)  # the filter by a lambda
    rows = anomaly.isolation_anomalies(df, ["a", "b"], trees=7, sample=64).collect()
    assert len(seen) == 2 and len(rows) == 7

    def path(t, x, depth=0):
        return depth + anomaly._c(t[0]) if len(t) == 1 else path(t[2] if x[t[0]] < t[1] else t[3], x, depth + 1)

    x = np.vstack((r.normal(0, 1, (200, 2)), [[np.nan, 0.0], [np.inf, -np.inf]]))
    for tree in (anomaly._grow(x[:100], r, 0, 6), anomaly._grow(x[:1], r, 0, 6)):
        assert anomaly._depths(*anomaly._levels(tree), x.T.ravel(), np.arange(len(x))).tolist() == [path(tree, v) for v in x]
