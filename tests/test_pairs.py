"""Batched pair tests against one regression at a time."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from tickloom.operators import cointegration as co

D0 = dt.date(2022, 1, 3)
BAR = "symbol string, date date, close double"


def plain_adf(x):
    """The statistic by least squares, lag by lag."""
    n = len(x)
    top = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 1)
    dx = np.diff(x)

    def fit(lags, start):
        rows = np.arange(start, len(dx))
        a = np.column_stack([x[rows]] + [dx[rows - k] for k in range(1, lags + 1)])
        coef = np.linalg.lstsq(a, dx[rows], rcond=None)[0]
        res = dx[rows] - a @ coef
        return a, coef, float(res @ res)

    aic = [(len(dx) - top) * math.log(fit(k, top)[2] / (len(dx) - top)) + 2 * (k + 1) for k in range(top + 1)]
    a, coef, rss = fit(int(np.argmin(aic)), int(np.argmin(aic)))
    return coef[0] / math.sqrt(rss / (len(a) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])


def walks(seed, n, m):
    r = np.random.RandomState(seed)
    return 100 + np.cumsum(r.normal(0, 1, (n, m)), axis=1)


@pytest.mark.parametrize("m", [60, 100, 252])
def test_statistics_of_a_stack_equal_single_ones(m):
    x = walks(m, 40, m)
    x[:20] = np.random.RandomState(1).normal(0, 1, (20, m))
    assert np.allclose(co.adf_t(x), [plain_adf(v) for v in x], rtol=1e-6)


def test_p_values_follow_the_surface():
    t = np.array([-30.0, -18.86, -3.5, -2.62, -2.0, 0.0, 0.92, 1.5])
    p = co.p_values(t)
    assert p[0] == 0.0 and p[-1] == 1.0 and np.all(np.diff(p) >= 0) and abs(p[2] - 0.0309) < 2e-3


def universe(spark):
    """60 walks with gaps, two of them tied together, one a copy."""
    r = np.random.RandomState(5)
    w = walks(4, 60, 260)
    w[7] = 0.5 * w[3] + r.normal(0, 0.4, 260)
    w[9] = w[2]
    rows = [(f"S{k:02d}", D0 + dt.timedelta(days=i), float(w[k, i])) for k in range(60) for i in range(260) if (k * 7 + i * 3) % 11]
    return spark.createDataFrame(rows, BAR), rows


def test_planted_pairs_are_found_and_blocks_agree(spark):
    bars, rows = universe(spark)
    got = {(r.symbol_a, r.symbol_b): r for r in co.tested_pairs(bars, 1.0, 150, per_block=7).collect()}
    one = {(r.symbol_a, r.symbol_b): r for r in co.tested_pairs(bars, 1.0, 150, per_block=1000).collect()}
    assert len(got) == 60 * 59 // 2 and got.keys() == one.keys()
    assert all(math.isclose(got[k].p_value, one[k].p_value, rel_tol=1e-9, abs_tol=1e-12) and got[k][3:] == one[k][3:] for k in got)
    assert got["S03", "S07"].p_value < 0.01 and got["S02", "S09"].p_value == 0.0
    by = {}
    for s, d, v in rows:
        by.setdefault(s, {})[d] = v
    for pair in (("S03", "S07"), ("S00", "S01"), ("S20", "S59")):
        days = sorted(by[pair[0]].keys() & by[pair[1]].keys())[-150:]
        a, b = (np.array([by[s][d] for d in days]) for s in pair)
        slope, intercept = np.polyfit(b, a, 1)
        e = got[pair]
        assert math.isclose(e.slope, slope, rel_tol=1e-6) and math.isclose(e.intercept, intercept, rel_tol=1e-5)
        assert math.isclose(e.p_value, co.p_values(np.array([plain_adf(a - slope * b - intercept)]))[0], rel_tol=1e-5, abs_tol=1e-9)
        s = (a - b)[-60:]
        assert math.isclose(e.z_score, (s[-1] - s.mean()) / s.std(ddof=1), rel_tol=1e-9)


def test_short_and_flat_series(spark):
    rows = [("A", D0 + dt.timedelta(days=i), 5.0) for i in range(120)] + [("B", D0 + dt.timedelta(days=i), float(i % 9)) for i in range(120)] + [("C", D0, 1.0)]
    got = co.tested_pairs(spark.createDataFrame(rows, BAR), 1.0, 100).collect()
    assert [(r.symbol_a, r.symbol_b) for r in got] == [("A", "B")] and got[0].slope == 0.0
    assert co.tested_pairs(spark.createDataFrame([], BAR), 1.0, 100).count() == 0


def test_a_symbol_lies_on_disk_once_however_many_blocks(spark):
    """The product of blocks reads them where they lie; no copies of series for each block are shuffled."""
    bars, _ = universe(spark)
    r = co.tested_pairs(bars, 1.0, 150, per_block=2)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert r.count() == 60 * 59 // 2 and r.select("symbol_a", "symbol_b").distinct().count() == 60 * 59 // 2


def test_only_dependent_series_need_a_qr(monkeypatch):
    """Sums of products give the statistic of plain series; series whose lags nearly depend on each other go to the QR."""
    x = np.concatenate([np.random.RandomState(3).normal(0, 1, (30, 100)), walks(8, 30, 100)])
    want = [plain_adf(v) for v in x]
    smooth = np.sin(np.arange(100) / 20 + np.arange(5)[:, None]) + np.random.RandomState(6).normal(0, 1e-6, (5, 100))
    seen, old, smooth_want = [], co._qr_t, co._qr_t(smooth)
    monkeypatch.setattr(co, "_qr_t", lambda v: seen.append(len(v)) or old(v))
    monkeypatch.setattr(co, "_FEW", 7)
    assert np.allclose(co.adf_t(x), want, rtol=1e-8) and not seen
    assert np.allclose(co.adf_t(np.concatenate([smooth, x])), [*smooth_want, *want], rtol=1e-8) and seen == [5]
    seen.clear()
    alternating = np.tile([1.0, -1.0], (3, 50))
    assert np.isfinite(co.adf_t(alternating)).all() and seen == [3]


def test_pairs_within_the_limit_are_not_looked_at(spark, monkeypatch):
    """A z-score is bounded before the pair's days are gathered; no pair at or above it is lost, also where days lie far apart."""
    monkeypatch.setattr(co, "_DAYS", 16)
    bars, _ = universe(spark)
    rows = [tuple(r) for r in bars.collect()]
    late = [(s, d + dt.timedelta(days=4000 * (i % 260 > 200)), 1e4 + v) for i, (s, d, v) in enumerate(rows)]
    for some in (rows, late):
        by = {}
        for s, d, v in sorted(some):
            by.setdefault(s, []).append(((d - dt.date(1970, 1, 1)).days, v))
        packs = [(b, names, *(np.array(x, k).tobytes() for x, k in (([len(by[s]) for s in names], np.int32), ([d for s in names for d, _ in by[s]], np.int32), ([v for s in names for _, v in by[s]], float)))) for b, names in enumerate(([*by][::2], [*by][1::2]))]
        for of in ([packs[0]], packs):
            block = co._unpacked(of)
            i, j, common = block.pairs(150, 60, 0.0)
            x, y = block.windows(i, j, common, 150)
            spread = (x - y)[:, -60:]
            sd = spread.std(axis=1, ddof=1)
            z = np.abs(spread[:, -1] - spread.mean(axis=1)) >= 1.5 * sd
            want = {(a, b) for a, b in zip(i[z].tolist(), j[z].tolist(), strict=True)}
            got = block.pairs(150, 60, 1.5)
            assert want <= set(zip(got[0].tolist(), got[1].tolist(), strict=True)) and len(want) <= len(got[0]) <= len(want) + 2 < len(i) / 2
            assert (got[0] < got[1]).all() and sorted(zip(*map(np.ndarray.tolist, got[:2]), strict=True)) == list(zip(*map(np.ndarray.tolist, got[:2]), strict=True))


def test_neutral_pairs_are_left_out_before_the_test(spark):
    bars, _ = universe(spark)
    every = {tuple(r) for r in co.cointegrated_pairs(bars, 0.9, 1.0, 150, per_block=20).collect()}
    some = {tuple(r) for r in co.cointegrated_pairs(bars, 0.9, 1.0, 150, per_block=20, neutral=False).collect()}
    assert some == {r for r in every if r[4] != "Neutral"} and 0 < len(some) < len(every)
    plan = co.cointegrated_pairs(bars, 0.9, 1.0, 150, per_block=20)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
