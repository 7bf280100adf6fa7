"""Maximum likelihood of GARCH(1,1) in batches."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import garch, risk

D0 = dt.date(2018, 1, 1)
BAR = "symbol string, date date, close double"


def simulated(seed, n, mu=0.05, omega=0.1, alpha=0.1, beta=0.85):
    r = np.random.RandomState(seed)
    h, e2, out = omega / (1 - alpha - beta), omega / (1 - alpha - beta), []
    for _ in range(n):
        h = omega + alpha * e2 + beta * h
        e = np.sqrt(h) * r.normal()
        e2 = e * e
        out.append(mu + e)
    return np.array(out)


def plain(r, mu, omega, alpha, beta):
    """Log-likelihood and last variance, one return at a time."""
    e2s = (r - r.mean()) ** 2
    w = 0.94 ** np.arange(min(75, len(r)))
    h = e2 = (w * e2s[: len(w)]).sum() / w.sum()
    total = 0.0
    for x in r:
        h = omega + alpha * e2 + beta * h
        e2 = (x - mu) ** 2
        total -= 0.5 * (np.log(2 * np.pi) + np.log(h) + e2 / h)
    return total, h


def test_likelihood_and_gradient():
    series = [simulated(1, 300), simulated(2, 120), simulated(3, 61)]
    d = garch.Returns(series)
    x = np.array([[0.1, -1.0, 2.0, -2.0], [0.0, -2.0, 1.0, -1.0], [0.3, 0.1, -0.5, 0.5]])
    f, g, last = garch.negative(d, x)
    for k, r in enumerate(series):
        want, h = plain(r, *(v[k] for v in garch.natural(x)))
        assert np.isclose(-f[k], want) and np.isclose(last[k], h)
    for j in range(4):
        y = x.copy()
        y[:, j] += 1e-6
        z = x.copy()
        z[:, j] -= 1e-6
        assert np.allclose((garch.negative(d, y)[0] - garch.negative(d, z)[0]) / 2e-6, g[:, j], rtol=1e-4, atol=1e-4)


def test_fit_is_never_below_the_grid_and_flat_at_the_top():
    d = garch.Returns([simulated(k, 80 + 40 * k) for k in range(20)] + [np.random.RandomState(k).standard_t(3, 200) for k in range(10)])
    x, loglik, _ = garch.fit(d)
    assert np.all(loglik >= -garch.negative(d, garch.start(d))[0] - 1e-9)
    for step in np.random.RandomState(1).normal(0, 0.05, (30, 4)):
        assert np.all(-garch.negative(d, x + step)[0] <= loglik + 0.05)


def test_parameters_of_long_series_are_recovered():
    d = garch.Returns([simulated(k, 6000) for k in range(6)])
    mu, omega, alpha, beta = garch.natural(garch.fit(d)[0])
    assert np.all(np.abs(mu - 0.05) < 0.06) and np.all(np.abs(alpha - 0.1) < 0.04) and np.all(np.abs(beta - 0.85) < 0.06) and abs(np.median(omega) - 0.1) < 0.05


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for k in range(5):
        px = 100.0
        for i, r in enumerate([0.0, *simulated(k, 250)]):
            px *= float(np.exp(r / 100))
            rows.append((f"S{k}", D0 + dt.timedelta(days=i), px))
    rows += [("SHORT", D0 + dt.timedelta(days=i), 10.0 + i) for i in range(30)] + [("FLAT", D0 + dt.timedelta(days=i), 5.0) for i in range(100)] + [("ONE", D0, 1.0)]
    return spark.createDataFrame(rows, BAR)


def test_symbols_do_not_depend_on_their_batch(bars):
    got = {r.symbol: r for r in garch.fitted(bars).collect()}
    assert set(got) == {f"S{k}" for k in range(5)}
    one = garch.Returns([simulated(3, 250)])
    x, loglik, last = garch.fit(one)
    assert abs(got["S3"].loglik - loglik[0]) < 1e-3 and abs(got["S3"].sigma - np.sqrt(last[0])) < 0.02


def test_likelihood_at_a_point(bars):
    for r in garch.loglik_at(bars, 0.07, 0.85).collect():
        x = simulated(int(r.symbol[1:]), 250)
        assert abs(r.loglik - plain(x, x.mean(), x.var() * 0.08, 0.07, 0.85)[0]) < 1e-6


def test_regimes(bars):
    got = {r.symbol: r.vol_regime for r in risk.vol_regime(bars).collect()}
    assert got["SHORT"] == got["FLAT"] == "Unknown" and "ONE" not in got and got["S1"] in ("Low", "Medium", "High")
