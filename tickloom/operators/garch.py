"""GARCH(1,1) with constant mean by maximum likelihood, many symbols at a time.

h[t] = omega + alpha * e[t-1]^2 + beta * h[t-1] with e = r - mu is a recursion in time but independent across symbols, so a
batch of symbols is one matrix and each step of the recursion one vector operation. The optimiser is a quasi-Newton search
with its own step and its own inverse Hessian per symbol. It starts at the best point of a coarse grid and never goes up,
so the fitted likelihood is never below the grid's.

The variance before the first return is the mean of the first 75 squared deviations, weighted by 0.94^i.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c

BATCH = 256  # symbols of one matrix
DECAY, FIRST = 0.94, 75
MOST = 0.9999  # alpha + beta stays below
GRID = [(a, p) for a in (0.03, 0.08, 0.15, 0.3) for p in (0.5, 0.8, 0.92, 0.98)]  # (alpha, alpha + beta), alpha below p
FIT = "symbol string, n long, mu double, omega double, alpha double, beta double, loglik double, sigma double"


class Returns:
    """Return series of unequal length as one matrix with its lengths and starting variances."""

    def __init__(self, series: list[np.ndarray]) -> None:
        self.n = np.array([len(x) for x in series])
        self.r = np.zeros((self.n.max(), len(series)))  # a row per step in time
        for k, x in enumerate(series):
            self.r[: len(x), k] = x
        self.mean = self.r.sum(axis=0) / self.n
        e2 = (self.r - self.mean) ** 2
        live = np.arange(len(self.r))[:, None] < self.n
        self.var = (e2 * live).sum(axis=0) / self.n
        w = np.where(np.arange(len(self.r))[:, None] < np.minimum(FIRST, self.n), DECAY ** np.arange(len(self.r))[:, None], 0.0)
        self.back = (w * e2).sum(axis=0) / w.sum(axis=0)

    def part(self, keep: np.ndarray) -> Returns:
        out = object.__new__(Returns)
        out.n, out.mean, out.var, out.back = self.n[keep], self.mean[keep], self.var[keep], self.back[keep]
        out.r = self.r[: out.n.max() if len(out.n) else 0, keep]
        return out


def natural(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """mu, omega, alpha, beta of free parameters (mu, log omega, logit of alpha + beta, logit of alpha's share)."""
    s = MOST / (1 + np.exp(-x[:, 2]))
    u = 1 / (1 + np.exp(-x[:, 3]))
    return x[:, 0], np.exp(x[:, 1]), s * u, s * (1 - u)


def free(mu: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    s = np.clip((alpha + beta) / MOST, 1e-9, 1 - 1e-9)
    u = np.clip(alpha / (alpha + beta), 1e-9, 1 - 1e-9)
    return np.stack([mu, np.log(omega), np.log(s / (1 - s)), np.log(u / (1 - u))], axis=1)


def negative(d: Returns, x: np.ndarray, slope: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negative log-likelihood, its gradient in the free parameters, and the last variance, for each symbol."""
    mu, omega, alpha, beta = natural(x)
    s, u = (alpha + beta) / MOST, alpha / (alpha + beta)
    zero = np.zeros(len(x))
    # derivatives of omega, alpha and beta in the free parameters
    d_omega = np.stack([zero, omega, zero, zero], axis=1)
    d_alpha = np.stack([zero, zero, alpha * (1 - s), alpha * (1 - u)], axis=1)
    d_beta = np.stack([zero, zero, beta * (1 - s), -alpha * (1 - u)], axis=1)
    total, grad = 0.5 * np.log(2 * np.pi) * d.n, np.zeros((len(x), 4))
    e2, h = d.back.copy(), d.back.copy()
    dh, de2, last = np.zeros((len(x), 4)), np.zeros(len(x)), h
    for t in range(len(d.r)):
        live = t < d.n
        if slope:
            dh = d_omega + d_alpha * e2[:, None] + d_beta * h[:, None] + beta[:, None] * dh
            dh[:, 0] += alpha * de2
        h = omega + alpha * e2 + beta * h
        e = d.r[t] - mu
        e2 = e * e
        total = total + np.where(live, 0.5 * (np.log(h) + e2 / h), 0.0)
        last = np.where(live, h, last)
        if slope:
            de2 = -2 * e
            g = (0.5 * (1 / h - e2 / h**2))[:, None] * dh
            g[:, 0] += 0.5 * de2 / h
            grad += np.where(live[:, None], g, 0.0)
    return total, grad, last


def start(d: Returns) -> np.ndarray:
    """The best grid point of each symbol: sample mean, omega by the sample variance."""
    best, low = None, np.full(len(d.n), np.inf)
    for a, p in GRID:
        if a >= p:
            continue
        x = free(d.mean, np.maximum(d.var * (1 - p), 1e-12), np.full(len(d.n), a), np.full(len(d.n), p - a))
        f = negative(d, x, slope=False)[0]
        best = x if best is None else np.where((f < low)[:, None], x, best)
        low = np.minimum(f, low)
    return best


def fit(d: Returns, rounds: int = 150, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Free parameters, log-likelihood and last variance at the maximum of each symbol."""
    x = start(d)
    f, g, last = negative(d, x)
    scale = np.stack([np.sqrt(d.var), np.ones(len(x)), np.ones(len(x)), np.ones(len(x))], axis=1) ** 2
    inverse = scale[:, :, None] * np.eye(4) / np.maximum(d.n, 1)[:, None, None]
    going = np.arange(len(x))
    for _ in range(rounds):
        if not len(going):
            break
        some = d.part(going)
        step = -np.einsum("sij,sj->si", inverse[going], g[going])
        down = (step * g[going]).sum(axis=1)
        bad = down >= 0
        step[bad], down[bad] = -g[going][bad] * scale[going][bad] / some.n[bad, None], -1.0
        step[:, 1:] = np.clip(step[:, 1:], -3, 3)
        down = np.minimum((step * g[going]).sum(axis=1), 0)
        size, left = np.ones(len(going)), np.arange(len(going))
        x1, f1, g1, l1 = x[going].copy(), f[going].copy(), g[going].copy(), last[going].copy()
        for _ in range(25):  # halve the steps of those that have not come down enough
            y = x[going[left]] + size[left, None] * step[left]
            fy, gy, ly = negative(some.part(left), y)
            ok = np.isfinite(fy) & (fy <= f[going[left]] + 1e-4 * size[left] * down[left])
            x1[left[ok]], f1[left[ok]], g1[left[ok]], l1[left[ok]] = y[ok], fy[ok], gy[ok], ly[ok]
            left = left[~ok]
            if not len(left):
                break
            size[left] /= 2
        sx, gy = x1 - x[going], g1 - g[going]
        curve = (sx * gy).sum(axis=1)
        new = curve > 1e-12
        rho = np.where(new, 1 / np.where(new, curve, 1), 0.0)
        eye = np.eye(4) - rho[:, None, None] * sx[:, :, None] * gy[:, None, :]
        updated = eye @ inverse[going] @ eye.transpose(0, 2, 1) + rho[:, None, None] * sx[:, :, None] * sx[:, None, :]
        inverse[going[new]] = updated[new]
        gain = f[going] - f1
        x[going], f[going], g[going], last[going] = x1, f1, g1, l1
        flat = np.abs(g1 * np.stack([np.sqrt(some.var), *np.ones((3, len(going)))], axis=1)).max(axis=1) < tol * some.n
        going = going[~(flat | (gain <= 1e-10 * np.abs(f1)))]
    return x, -f, last


def _fitted(batches):
    for pdf in batches:
        for i in range(0, len(pdf), BATCH):
            some = pdf.iloc[i : i + BATCH]
            d = Returns([np.asarray(v, float) for v in some.r])
            x, loglik, last = fit(d)
            mu, omega, alpha, beta = natural(x)
            yield pd.DataFrame({"symbol": some.symbol.values, "n": d.n, "mu": mu, "omega": omega, "alpha": alpha, "beta": beta, "loglik": loglik, "sigma": np.sqrt(last)})


def packed_returns(bars: DataFrame, min_obs: int) -> DataFrame:
    """(symbol, r): log returns in percent in order of date, of symbols with enough of them that move at all. An array is
    as long as the calendar at most."""
    b = bars.withColumn("_r", ts.log_return(c.close) * 100.0).filter("_r is not null")
    r = F.transform(F.array_sort(F.collect_list(F.struct("date", "_r"))), lambda x: x["_r"])
    return b.groupBy("symbol").agg(r.alias("r"), F.var_pop("_r").alias("_v")).filter((F.size("r") >= min_obs) & (F.col("_v") > 1e-12)).select("symbol", "r")


def fitted(bars: DataFrame, min_obs: int = 60) -> DataFrame:
    """Maximum-likelihood parameters of every symbol with at least ``min_obs`` returns that vary (percent returns)."""
    return packed_returns(bars, min_obs).mapInPandas(_fitted, FIT)


def loglik_at(bars: DataFrame, alpha: float, beta: float, min_obs: int = 60) -> DataFrame:
    """Log-likelihood of every symbol at given alpha and beta, with the sample mean and the sample variance's omega."""

    def fold(v: Column, mu: Column, back: Column) -> Column:
        omega = v * (1.0 - alpha - beta)

        def step(acc: Column, x: Column) -> Column:
            h = omega + alpha * acc["e2"] + beta * acc["h"]
            e2 = (x - mu) * (x - mu)
            return F.struct(h.alias("h"), e2.alias("e2"), (acc["ll"] - 0.5 * (F.lit(float(np.log(2 * np.pi))) + F.log(h) + e2 / h)).alias("ll"))

        return F.aggregate("r", F.struct(back.alias("h"), back.alias("e2"), F.lit(0.0).alias("ll")), step)["ll"]

    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    t = packed_returns(bars, min_obs).withColumn("mu", add("r") / F.size("r"))
    t = t.withColumn("e", F.transform("r", lambda x: (x - c.mu) * (x - c.mu)))
    w = F.transform(F.sequence(F.lit(0), F.least(F.lit(FIRST), F.size("r")) - 1), lambda i: F.pow(F.lit(DECAY), i))
    t = t.withColumns({"v": add("e") / F.size("e"), "w": w})
    t = t.withColumn("back", add(F.zip_with("w", F.slice("e", F.lit(1), F.size("w")), lambda a, b: a * b)) / add("w"))
    return t.select("symbol", F.size("r").cast("long").alias("n"), c.mu, c.v.alias("variance"), c.back.alias("backcast"), fold(c.v, c.mu, c.back).alias("loglik"))
