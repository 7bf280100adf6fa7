"""Literal fixtures of rules that must hold whatever the SQL twins say."""

from __future__ import annotations

import datetime as dt
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tickloom.operators import anomaly, broker, quality
from tickloom.plans.tables import latest_supplier_bars, supplier_bars, ticks
from tickloom.sources import bars as B
from tickloom.sources import files as fl
from tickloom.streaming import ticks as tk

SF = "/root/testdata/sf0.001"
D0 = dt.date(2024, 1, 1)
BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def contract(spark, details, option, file="NSE_FO"):
    row = ("T", details, 11, 1, 0.05, "1750896000", "tick", "u", 1.0, option)
    raw = spark.createDataFrame([row], "token string, details string, instrument int, lotsize int, tick_size double, expiry_epoch string, ticker string, underlying string, strike double, option_type string")
    return broker.derivative_contracts(raw, file).first()


def test_contract_symbols(spark):
    assert contract(spark, "AXIS 26 Jun 25 FUT", "XX").symbol == "AXIS25JUN26FUT"
    assert contract(spark, "NIFTY 26 Jun 25 24500", "CE").symbol == "NIFTY25JUN2624500CE"
    assert contract(spark, "NIFTY 26 Jun 25 24500", "PE").instrumenttype == "PE"
    bse = contract(spark, "SENSEX 27 Jun 25 FUT", None, "BSE_FO")
    assert (bse.symbol, bse.instrumenttype, bse.expiry) == ("SENSEX25JUN27FUT", "FUT", "26-JUN-25")
    nse = contract(spark, "AXIS 26 Jun 25 FUT", None)
    assert nse.symbol is None and nse.instrumenttype is None


def bars(spark, closes, symbol="S"):
    return spark.createDataFrame([(symbol, D0 + dt.timedelta(days=i), float(x), float(x), float(x), float(x), 1.0) for i, x in enumerate(closes)], BAR)


def last_verdict(spark, closes, **kw):
    return quality.bar_gate(bars(spark, closes), **kw).orderBy(F.desc("date")).first().verdict


def test_gate_decisions(spark):
    r = np.random.default_rng(42)
    calm = list(100 * np.exp(np.cumsum(r.normal(0, 0.002, 80))))
    flag = F.col("date") == F.lit(D0 + dt.timedelta(days=80))
    assert last_verdict(spark, [*calm, calm[-1] * 0.84], flagged=flag) == "CORP_ACTION"  # flagged, within 0.05 of 0.8
    assert last_verdict(spark, [*calm, calm[-1] * 0.84]) == "OK"  # z above 5 alone is not enough
    assert last_verdict(spark, [*calm, calm[-1] * 1.1], flagged=flag) == "BAD_TICK"
    assert last_verdict(spark, [*calm, calm[-1] * 0.5]) == "CORP_ACTION"
    assert last_verdict(spark, [*calm, calm[-1] * 1.5]) == "BAD_TICK"
    assert last_verdict(spark, [*calm, calm[-1] * 1.0001], flagged=flag) == "OK"


@pytest.mark.parametrize("ratio,want", [(2.5, "OK"), (0.5, "CORP_ACTION"), (0.73, "BAD_TICK"), (0.7, "CORP_ACTION"), (0.95, "OK"), (1 / 3, "CORP_ACTION"), (0.6167, "CORP_ACTION"), (0.61, "BAD_TICK")])
def test_gate_fallback(spark, ratio, want):
    assert quality.gate_fallback(bars(spark, [100.0]), bars(spark, [0.0, 100.0 * ratio]).filter("close > 0")).first().decision == want
    assert last_verdict(spark, [100.0, 100.0 * ratio]) == want  # under 50 bars the plain rule decides


def test_integrity_counts_each_fault(spark):
    d = lambda k: D0 + dt.timedelta(days=k)
    rows = [
        ("A", d(0), 10.0, 11.0, 9.0, 10.0, 1.0), ("A", d(0), 10.0, 11.0, 9.0, 10.0, 1.0), ("A", d(1), 10.0, 8.0, 9.0, 20.0, None), ("A", d(12), -1.0, math.inf, -2.0, math.nan, 1.0),
    ]
    g = quality.integrity(spark.createDataFrame(rows, BAR)).first()
    assert (g.rows, g.duplicate_rows, g.null_volume, g.null_close, g.inf_high, g.null_open) == (4, 1, 1, 1, 1, 0)
    assert (g.non_positive, g.bound_violations, g.extreme_returns, g.long_gaps) == (2, 3, 1, 1)


@pytest.mark.parametrize("build", [lambda s: supplier_bars(s, SF), lambda s: B.intraday_bars(ticks(s, SF), "4 hours"), lambda s: supplier_bars(s, SF).select("close")])
def test_bars_never_sort_trades(spark, build):
    plan = build(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan and "Sort [" not in plan


def test_newest_day_is_pruned(spark):
    newest = latest_supplier_bars(spark, SF)
    assert newest.select("date").distinct().count() == 1
    assert newest.first().date == supplier_bars(spark, SF).agg(F.max("date")).first()[0]


def test_symbol_of_a_folder(spark, tmp_path):
    spark.range(3).repartition(2).write.parquet(str(tmp_path / "ACME.parquet"))
    assert {r.symbol for r in fl.read_symbol_files(spark, str(tmp_path / "ACME.parquet")).collect()} == {"ACME"}


def test_daily_files_of_two_generations(spark, tmp_path):
    (tmp_path / "sec_20240102.csv").write_text(" SYMBOL, SERIES, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TURNOVER_LACS, TTL_TRD_QNTY, DELIV_QTY, DELIV_PER\nAA, EQ, 1, 2, 0.5, 1.5, 0.25, 10, -, 40\nBB, BE, 1, 2, 0.5, 1.5, 0.25, 10, 4, 40\n")
    (tmp_path / "sec_20240103.csv").write_text("ClsPric,TckrSymb,SctySrs,TtlTrfVal,OpnPric,HghPric,LwPric,TtlTrdQnty\n1.6,AA,EQ,26000,1,2,0.5,11\n")
    raw = fl.read_daily_files(spark, str(tmp_path))
    got = sorted(map(tuple, fl.normalise_daily(raw, keep=["day"]).collect()))
    assert got == [(dt.date(2024, 1, 2), "AA", 25000.0, 1.5, None, 40.0), (dt.date(2024, 1, 3), "AA", 26000.0, 1.6, None, None)]
    assert fl.daily_ohlcv(raw, F.col("day")).count() == 2


def test_quoted_cells_and_ragged_lines(spark, tmp_path):
    (tmp_path / "sec_20240104.csv").write_text('TckrSymb,FinInstrmNm,SctySrs,TtlTrfVal,ClsPric\nAA,"Acme, Ltd",EQ,100,1.5\nBB,Bee,EQ,200\nCC,"See ""C""",EQ,300,2.5,,\nDD,Dee,EQ,400,3.5,9\n\nTckrSymb,ClsPric,SctySrs,TtlTrfVal\nEE,4.5,EQ,500\n')
    (tmp_path / "sec_20240105.csv").write_text("")
    got = sorted(map(tuple, fl.normalise_daily(fl.read_daily_files(spark, str(tmp_path))).select("symbol", "turnover", "close").collect()))
    assert got == [("AA", 100.0, 1.5), ("CC", 300.0, 2.5), ("EE", 500.0, 4.5)]
    assert [tuple(r) for r in fl.ragged_lines(spark, str(tmp_path)).collect()] == [(dt.date(2024, 1, 4), 5, 2, "BB,Bee,EQ,200")]


def test_repeat_filter_stream_equals_batch(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1, 9, 0, 0) + dt.timedelta(milliseconds=ms)
    kind = "symbol string, ts timestamp, seq long, price double"
    rows = [("A", at(10 * i), i, p) for i, p in enumerate([1.0, 2.0, 1.0, 1.0, 2.0])] + [("A", at(1000), 5, 2.0), ("B", at(20), 6, 1.0), ("B", at(30), 7, 1.0), ("A", at(1100), 8, 2.0)]
    for k in range(3):  # three micro-batches
        spark.createDataFrame(rows[3 * k : 3 * k + 3], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tk.drop_repeats_stream(s).writeStream.format("memory").queryName("repeats_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = sorted(r.seq for r in tk.drop_repeats(spark.createDataFrame(rows, kind)).collect())
    assert want == [0, 1, 2, 4, 5, 6] and sorted(r.seq for r in spark.table("repeats_out").collect()) == want


def test_forest_flags_an_exact_share(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(0, 1, (1999, 2)))] + [(9999, 30.0, -30.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double").repartition(7)
    got = anomaly.isolation_anomalies(df, ["a", "b"], trees=20).collect()
    assert got[0].id == 9999 and len(got) == 20
    scored = spark.createDataFrame([(-x / 1000,) for x in range(1000)], "score double")
    assert abs(anomaly.exact_cut(scored, 0.01) - np.percentile([-x / 1000 for x in range(1000)], 1)) < 1e-12


def test_workers_import_the_package(tmp_path):
    """Tasks find the package from any working folder once it is on the path, as with an installed package or --py-files."""
    code = "from tickloom.session import local_session; s = local_session('w', 1)\nfrom tickloom.plans.catalog import CATALOG\nimport tickloom.plans.q_scanners\nprint('rows', CATALOG['q6_anomalies'].build(s, '/root/testdata/sf0.001').count())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))}, capture_output=True, text=True, timeout=300)
    assert "rows 54" in out.stdout, out.stderr[-2000:]


def test_a_files_day_and_header_are_found_once(spark, tmp_path, monkeypatch):
    """Not again for each line: the day is parsed before the lines are, and aliases are looked up once for many lines."""
    looked = []

    class Aliases(dict):
        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k)

    (tmp_path / "day=20240106").mkdir()
    (tmp_path / "day=20240106" / "a.csv").write_text("SYMBOL,SERIES,CLOSE,TURNOVER\n" + "".join(f"S{i},EQ,{i},{2 * i}\n" for i in range(500)) + "S,EQ\n")
    raw = fl.read_daily_files(spark, str(tmp_path / "*"), r"day=(\d{8})", "path")
    assert {(r.day, r.SYMBOL, r.TURNOVER) for r in raw.collect()} == {(dt.date(2024, 1, 6), f"S{i}", str(2 * i)) for i in range(500)}
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("regexp_extract")
    import pyarrow as pa

    monkeypatch.setattr(fl, "ALIASES", Aliases(fl.ALIASES))
    batch = pa.RecordBatch.from_arrays([pa.array(["x/a.csv"]), pa.array([dt.date(2024, 1, 6)]), pa.array([b"SYMBOL,SERIES\n" + b"A,EQ\n" * 900 + b"B\n"])], ["path", "day", "content"])
    got = pa.Table.from_batches(list(fl._parsed_files(iter([batch]))))
    assert got.num_rows == 901 and len(looked) < 50 and sorted(got.column("line").to_pylist()) == list(range(2, 903))


def test_order_codes_and_bans(spark):
    o = spark.createDataFrame([("BUY", "MARKET", "CNC"), ("HOLD", "??", "??")], "action string, pricetype string, product string")
    known, unknown = broker.encode_orders(o).collect()
    assert known.side == 1 and unknown.side is None and unknown.type == 2 and unknown.product_code == "INTRADAY"
    rows = spark.createDataFrame([(" acme.ns",), ("Other",)], "symbol string")
    got = fl.flag_banned(rows, spark.createDataFrame([("ACME",)], "symbol string"))
    assert sorted((r.symbol, r.banned) for r in got.collect()) == [(" acme.ns", True), ("Other", False)]


def test_forest_chain(spark):
    """Forest to evaluation to return: rows split by time, probabilities, and confusion counts that add up."""
    import tickloom.plans.q_scanners as qs
    from tickloom.operators import learn, portfolio

    spark.range(3).observe(Observation(), F.count("id").alias("n")).collect()  # gives the session an observation manager
    t = learn.chronological(qs._features(spark, SF))
    p = learn.fit_predict(t.cache(), trees=10).cache()
    n = {r.symbol: r["count"] for r in t.groupBy("symbol").count().collect()}
    rows = p.collect()
    assert all(0 <= r.probability <= 1 and r.prediction == int(r.probability > 0.5) for r in rows if r.probability != 0.5)
    got = {r.symbol: r for r in learn.evaluate(p).collect()}
    for s, e in got.items():
        own = [r for r in rows if r.symbol == s]
        assert e.n == len(own) == n[s] - math.floor(n[s] * 0.8)
        assert math.isclose(e.accuracy, sum(r.prediction == r.target for r in own) / e.n)
    assert {r.symbol for r in portfolio.strategy_vs_hold(p, "prediction").collect()} == set(got)
