"""Cointegrated pairs of a symbol universe by blocks of pairs.

Every pair has to be tested (no bound on the statistic follows from the prices), so the work is quadratic by definition.
Spark splits it: symbols hash into blocks, a block is one row, and a product of the blocks with themselves hands every two of
them to a task, i.e. a bounded number of price rows at a time. On disk a symbol lies once, however many blocks there are.
Inside, all pairs of the two blocks are tested at once: their common days are a product of
presence masks, their last ``lookback`` common bars two matrices, and every regression of the test one stacked QR. Only
pairs that pass are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import c, rnd
from ..session import written
from .consensus import signal

# fixed values: MacKinnon response surface for two variables with a constant
_SMALL, _LARGE, _STAR, _MIN, _MAX = (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377), -2.62, -18.86, 0.92
_CELLS = 1 << 22  # numbers of one stacked design: more pairs than fit are tested in parts
_DAYS = 64  # days whose sums of spreads are one matrix product
_PART, _FEW = 4096, 512  # series that are tested at once; those whose products are, which fit a core's cache
_DEPENDENT = 1e-6  # a column with less than this of its square apart from the columns before it is left to a QR
_ERFC = np.frompyfunc(math.erfc, 1, 1)


def p_values(t: np.ndarray) -> np.ndarray:
    """Approximate p-values of Engle-Granger statistics (two variables)."""
    inside = np.clip(t, _MIN, _MAX)
    z = np.where(inside <= _STAR, np.polyval(_SMALL[::-1], inside), np.polyval(_LARGE[::-1], inside))
    p = 0.5 * _ERFC(-z / math.sqrt(2.0)).astype(float)
    return np.where(t > _MAX, 1.0, np.where(t < _MIN, 0.0, p))


def _design(x: np.ndarray, lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each series: its lagged differences and, last, its level; and the differences they explain."""
    dx = np.diff(x, axis=1)
    rows = np.arange(start, dx.shape[1])
    cols = [dx[:, rows - k] for k in range(1, lags + 1)] + [x[:, rows]]
    return np.stack(cols, axis=2), dx[:, rows]


def _qr_t(x: np.ndarray) -> np.ndarray:
    """``adf_t`` by stacked QR, for series of any condition."""
    n = x.shape[1]
    top = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 1)
    design, y = _design(x, top, top)
    # columns level, lag 1, lag 2, ...: a QR of the largest model holds those of all smaller ones
    q, _ = np.linalg.qr(np.concatenate([design[:, :, -1:], design[:, :, :-1]], axis=2))
    share = np.einsum("pmk,pm->pk", q, y) ** 2
    rss = np.maximum((y**2).sum(axis=1)[:, None] - np.cumsum(share, axis=1), 1e-300)
    m = y.shape[1]
    aic = m * np.log(rss / m) + 2 * np.arange(1, top + 2)
    best = aic.argmin(axis=1)
    out = np.empty(len(x))
    for lags in np.unique(best):  # one stack for each lag order, at most ``top + 1``
        some = best == lags
        design, y = _design(x[some], int(lags), int(lags))
        q, r = np.linalg.qr(design)
        b = np.einsum("pmk,pm->pk", q, y)
        rest = np.maximum((y**2).sum(axis=1) - (b**2).sum(axis=1), 1e-300)
        s = np.sqrt(rest / (y.shape[1] - design.shape[2]))
        out[some] = np.sign(r[:, -1, -1]) * b[:, -1] / s  # the level's coefficient over its standard error
    return out


def _explained(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of products (k, k, series) of some columns and, last, of y: the length of y along each column after those before it,
    and whether no column nearly depends on those before it. w is used up, its lower half read."""
    k = len(w) - 1
    along, sure, whole = np.empty((k, w.shape[2])), np.ones(w.shape[2], bool), [w[i, i].copy() for i in range(k)]
    for i in range(k):
        sure &= w[i, i] > _DEPENDENT * whole[i]
        col = w[i + 1 :, i] / np.sqrt(np.where(sure, w[i, i], 1.0))
        along[i] = col[-1]
        for j in range(k - i):
            w[i + 1 + j, i + 1 : i + 2 + j] -= col[j] * col[: j + 1]
    return along, sure


def _products(level: np.ndarray, d: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over rows ``top`` and on, with d[t] as lag 0 and d[t - k] as lag k: [k, j], lag k times lag j for j <= k; [k], the level
    times lag k; the level's square. Sums of products with the same distance differ by products at the ends alone."""
    n, series = level.shape
    lags, levels = np.empty((top + 1, top + 1, series)), np.empty((top + 1, series))
    for gap in range(top + 1):
        p = d[gap:] * d[: n - 1 - gap]
        s = p[top - gap :].sum(axis=0)
        lags[gap, 0] = s
        if gap < top:  # lag j + gap times lag j: one more product in front, the last one gone
            ends = p[: top - gap][::-1] - p[n - 1 - top :][::-1]
            ends[0] += s
            j = np.arange(1, top - gap + 1)
            lags[j + gap, j] = np.cumsum(ends, axis=0, out=ends)
    p = level[:-1] * d
    levels[0] = p[top:].sum(axis=0)
    if top:
        levels[1:] = levels[0] + np.cumsum(p[:top][::-1] - p[n - 1 - top :][::-1], axis=0)
    for k in range(1, top + 1):  # the level is what it was before k differences, and these
        levels[k] += lags[k, 1 : k + 1].sum(axis=0)
    return lags, levels, np.einsum("tp,tp->p", level[top:-1], level[top:-1])


def _order(lags: np.ndarray, levels: np.ndarray, square: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The lag order of least AIC on ``rows`` rows, and whether it is sure."""
    top = len(levels) - 1
    w = np.empty((top + 2, top + 2, len(square)))  # level, lag 1, lag 2, ..., y: the largest model holds all smaller ones
    w[0, 0] = square
    for k in range(1, top + 1):
        w[k, 0], w[k, 1 : k + 1] = levels[k], lags[k, 1 : k + 1]
    w[top + 1, 0], w[top + 1, 1 : top + 1], w[top + 1, top + 1] = levels[0], lags[1:, 0], lags[0, 0]
    along, sure = _explained(w)
    rss = lags[0, 0] - np.cumsum(along**2, axis=0)
    sure &= rss[-1] > _DEPENDENT * lags[0, 0]
    aic = rows * np.log(np.where(sure, rss, 1.0) / rows) + 2 * np.arange(1, top + 2)[:, None]
    return aic.argmin(axis=0), sure


def _normal_t(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``adf_t`` by normal equations, and of which series it is sure."""
    n = x.shape[1]
    top = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 1)
    lags, levels, square = np.empty((top + 1, top + 1, len(x))), np.empty((top + 1, len(x))), np.empty(len(x))
    best, sure, out = np.empty(len(x), np.intp), np.empty(len(x), bool), np.zeros(len(x))
    for i in range(0, len(x), _FEW):
        some = slice(i, i + _FEW)
        level = np.ascontiguousarray(x[some].T)
        lags[:, :, some], levels[:, some], square[some] = now = _products(level, level[1:] - level[:-1], top)
        best[some], sure[some] = _order(*now, n - 1 - top)
    for k in np.unique(best[sure]).tolist():
        some = np.flatnonzero(sure & (best == k))
        w = np.empty((k + 2, k + 2, len(some)))  # lag 1, ..., the level, y; then the rows that smaller models have more
        for j in range(1, k + 1):
            w[j - 1, :j] = lags[j, 1 : j + 1].take(some, axis=1)
            w[k, j - 1], w[k + 1, j - 1] = levels[j].take(some), lags[j, 0].take(some)
        w[k, k], w[k + 1, k], w[k + 1, k + 1] = square.take(some), levels[0].take(some), lags[0, 0].take(some)
        was = np.ascontiguousarray(x[some, : top + 1].T)
        now = was[1:] - was[:-1]
        for t in range(k, top):
            v = np.concatenate((now[t - k : t][::-1], was[t : t + 1], now[t : t + 1]))
            for j in range(k + 2):
                w[j, : j + 1] += v[j] * v[: j + 1]
        rest = w[k + 1, k + 1].copy()
        along, ok = _explained(w)
        left = rest - (along**2).sum(axis=0)
        sure[some] = ok & (left > _DEPENDENT * rest)
        out[some] = along[-1] / np.sqrt(np.where(sure[some], left, 1.0) / (n - 1 - k - (k + 1)))  # the level's coefficient over its standard error
    return out, sure


def adf_t(x: np.ndarray) -> np.ndarray:
    """ADF t statistic without constant of each row of x; lag order by AIC on a common sample."""
    out = np.empty(len(x))
    for i in range(0, len(x), _PART):
        part = x[i : i + _PART]
        t, sure = _normal_t(part)
        step = max(1, _CELLS // (x.shape[1] * 16))
        left = np.flatnonzero(~sure)
        for k in range(0, len(left), step):
            t[left[k : k + step]] = _qr_t(part[left[k : k + step]])
        out[i : i + _PART] = t
    return out


def regressed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and residuals of a on b, row by row."""
    ma, mb = a.mean(axis=1, keepdims=True), b.mean(axis=1, keepdims=True)
    da, db = a - ma, b - mb
    sxx = (db**2).sum(axis=1)
    slope = np.where(sxx > 0, (da * db).sum(axis=1) / np.where(sxx > 0, sxx, 1), 0.0)
    return slope, (ma - slope[:, None] * mb)[:, 0], da - slope[:, None] * db


def _residual_p(a: np.ndarray, res: np.ndarray) -> np.ndarray:
    """p-values of the residuals of a; no residual at all gives 0."""
    left = np.flatnonzero(np.abs(res).max(axis=1) > 1e-8 * np.maximum(1.0, np.abs(a).max(axis=1)))
    out = np.zeros(len(a))
    out[left] = p_values(adf_t(res if len(left) == len(res) else res[left]))
    return out


def engle_granger(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """p-values of no cointegration between the rows of two matrices of aligned prices."""
    return _residual_p(a, regressed(a, b)[2])


class _Block:
    """Prices of some symbols on a grid of days."""

    def __init__(self, symbols: list[str], sizes: np.ndarray, days: np.ndarray, values: np.ndarray, block: np.ndarray) -> None:
        order = np.argsort(np.array(symbols, object))
        self.symbols = [symbols[i] for i in order]
        self.block = block[order]
        grid, at = np.unique(days, return_inverse=True)
        row = np.repeat(np.argsort(order), sizes)
        self.price = np.zeros((len(symbols), len(grid)))
        self.there = np.zeros((len(symbols), len(grid)), bool)
        self.price[row, at], self.there[row, at] = values, True

    def pairs(self, lookback: int, z_window: int, min_z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, common days), i before j and ascending, with enough common days and a z-score that may reach min_z; of two
        blocks only pairs across."""
        first = self.block == self.block[0]
        one, two = (first, first) if first.all() else (first, ~first)
        one, two = np.flatnonzero(one), np.flatnonzero(two)
        common = self.there[one].astype(np.float32) @ self.there[two].T.astype(np.float32)
        ok = common >= lookback
        if first.all():
            ok = np.triu(ok, 1)
        if min_z > 0 and min(z_window, lookback) > 1:
            ok = self._apart(one, two, ok, min(z_window, lookback), min_z)
        a, b = np.nonzero(ok)
        i, j = np.minimum(one[a], two[b]), np.maximum(one[a], two[b])
        order = np.lexsort((j, i))
        return i[order], j[order], common[a, b].astype(np.intp)[order]

    def _apart(self, one: np.ndarray, two: np.ndarray, ok: np.ndarray, window: int, min_z: float) -> np.ndarray:
        """Of the pairs (one, two) that are ok, those whose last spread may be min_z deviations from the mean of the last
        ``window`` common ones. Sums of spreads and of their squares over some days are matrix products; only the days in
        which a pair's window begins are looked at pair by pair. Where the sums are not sure the pair stays."""
        there = self.there.astype(float)
        price = self.price - there * (self.price.sum(axis=1) / np.maximum(there.sum(axis=1), 1))[:, None]
        square = price**2
        scale = square.sum(axis=1)
        scale = scale[one][:, None] + scale[two]
        n, s1, s2, end = (np.zeros(ok.shape) for _ in range(4))

        def both(a, b, days):
            """Common days of pairs and the spreads on all of them, the last day first."""
            return (self.there[one[a], days] & self.there[two[b], days])[:, ::-1], (price[one[a], days] - price[two[b], days])[:, ::-1]

        for stop in range(price.shape[1], 0, -_DAYS):
            days = slice(max(0, stop - _DAYS), stop)
            xs, ys = [t[one, days] for t in (there, price, square)], [t[two, days] for t in (there, price, square)]
            k = xs[0] @ ys[0].T
            after = n + k
            whole = after <= window
            s1 += np.where(whole, np.hstack((xs[1], -xs[0])) @ np.hstack((ys[0], ys[1])).T, 0.0)
            s2 += np.where(whole, np.hstack((xs[2], xs[0], -2 * xs[1])) @ np.hstack((ys[0], ys[2], ys[1])).T, 0.0)
            a, b = np.nonzero(ok & (n == 0) & (k > 0))
            if len(a):
                m, spread = both(a, b, days)
                end[a, b] = spread[np.arange(len(a)), m.argmax(axis=1)]
            a, b = np.nonzero(ok & (n < window) & ~whole)
            if len(a):
                m, spread = both(a, b, days)
                spread[~m | (np.cumsum(m, axis=1, dtype=np.int16) > (window - n[a, b])[:, None])] = 0.0
                s1[a, b] += spread.sum(axis=1)
                s2[a, b] += np.einsum("pd,pd->p", spread, spread)
            n = np.minimum(after, window)
            if n[ok].min(initial=window) >= window:
                break
        rest = s2 - s1**2 / window
        unsure = ~(rest > 1e-5 * scale)
        return ok & (unsure | ((end - s1 / window) ** 2 >= min_z**2 * (1 - 1e-6) * rest / (window - 1)))

    def windows(self, i: np.ndarray, j: np.ndarray, common: np.ndarray, lookback: int) -> tuple[np.ndarray, np.ndarray]:
        """Prices of the last ``lookback`` common days of each pair; i ascends. Only days of the first symbol are looked at."""
        x, y = np.empty((len(i), lookback)), np.empty((len(i), lookback))
        firsts, starts = np.unique(i, return_index=True)
        back, width = np.arange(-lookback, 0), self.price.shape[1]
        for first, start, stop in zip(firsts, starts, [*starts[1:], len(i)], strict=True):
            days, others = np.flatnonzero(self.there[first]), j[start:stop]
            at = np.flatnonzero(self.there[others].take(days, axis=1))  # common days, pair after pair
            at = at[np.cumsum(common[start:stop])[:, None] + back]
            at -= (np.arange(len(others)) * len(days))[:, None]
            np.take(self.price[first].take(days), at, out=x[start:stop])
            at = days.take(at)
            at += (others * width)[:, None]
            np.take(self.price, at, out=y[start:stop])
        return x, y


_OUT = "symbol_a string, symbol_b string, p_value double, slope double, intercept double, residual_sd double, z_score double"


_PACKED = "b int, symbols array<string>, sizes binary, days binary, prices binary"
_TASKS = 24  # partitions of the blocks where they are many: their square is the number of tasks
_SHARE = 128  # blocks at most in a partition, in the mean


def _pack(key, pdf):
    """The series of a block behind each other."""
    days, prices = [np.asarray(x, np.int32) for x in pdf.d], [np.asarray(x, np.float64) for x in pdf.v]
    sizes = np.array([len(x) for x in days], np.int32)
    return pd.DataFrame({"b": [key[0]], "symbols": [pdf.symbol.tolist()], "sizes": [sizes.tobytes()], "days": [np.concatenate(days).tobytes()], "prices": [np.concatenate(prices).tobytes()]})


def _unpacked(packs: list[tuple]) -> _Block:
    """One block, or two with each other."""
    symbols, sizes, days, prices = ([t[k] for t in packs] for k in range(1, 5))
    of = np.repeat([t[0] for t in packs], [len(t) for t in symbols])
    read = lambda parts, kind: np.concatenate([np.frombuffer(t, kind) for t in parts])
    return _Block(sum(symbols, []), read(sizes, np.int32), read(days, np.int32), read(prices, np.float64), of)


def _blocks(bars: DataFrame, lookback: int, per_block: int) -> DataFrame:
    """Every two blocks, also each with itself, in one row: columns of ``_PACKED`` for the first, then for the second.

    Each symbol is written and shuffled once; the tasks of the product read the blocks of two partitions each.
    """
    packed = written(
        bars.filter("close is not null").groupBy("symbol")
        .agg(F.array_sort(F.collect_list(F.struct(F.datediff("date", F.lit("1970-01-01").cast("date")).alias("d"), "close"))).alias("s"))
        .filter(F.size("s") >= lookback)
        .select("symbol", F.col("s.d").alias("d"), F.col("s.close").alias("v"))
    )
    blocks = max(1, math.ceil(packed.count() / per_block))
    of = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("b")
    packs = packed.groupBy(of).applyInPandas(_pack, _PACKED)
    one = packs.repartition(min(blocks, max(_TASKS, blocks // _SHARE)), "b")
    two = one.toDF(*[f"{x}_2" for x in one.columns])
    return one.join(two.hint("shuffle_replicate_nl"), F.col("b") <= F.col("b_2"))


def tested_pairs(bars: DataFrame, max_p: float | None = 0.05, lookback: int = 252, z_window: int = 60, per_block: int = 256, min_z: float = 0.0) -> DataFrame:
    """Pairs with at least ``lookback`` common bars: regression of the earlier symbol on the later one over their last
    ``lookback`` common bars, p-value of no cointegration, z-score of the price difference over the last ``z_window``.

    Pairs with a p-value above ``max_p`` or a z-score below ``min_z`` are left out where they are tested; without ``max_p``
    no test is run and p_value is NULL. One number is fetched first: how many symbols there are, to size the blocks.
    """

    names = _OUT.replace(" string", "").replace(" double", "").split(", ")

    def tested(blk: _Block) -> Iterator[pa.RecordBatch]:
        i, j, common = blk.pairs(lookback, z_window, min_z)
        symbols = pa.array(blk.symbols, pa.string())
        step = max(1, min(_PART, _CELLS // max(lookback, z_window)))
        for k in range(0, len(i), step):
            some = slice(k, k + step)
            x, y = blk.windows(i[some], j[some], common[some], lookback)
            spread = (x - y)[:, -z_window:]
            sd = spread.std(axis=1, ddof=1) if spread.shape[1] > 1 else np.zeros(len(x))
            z = np.where(sd > 0, (spread[:, -1] - spread.mean(axis=1)) / np.where(sd > 0, sd, 1), np.nan)
            keep = np.flatnonzero(np.nan_to_num(np.abs(z)) >= min_z)
            x, y = (x, y) if len(keep) == len(x) else (x[keep], y[keep])
            slope, intercept, res = regressed(x, y)
            p = np.full(len(keep), np.nan)
            if max_p is not None:
                p = _residual_p(x, res)
                few = np.flatnonzero(p <= max_p)
                keep, slope, intercept, res, p = keep[few], slope[few], intercept[few], res[few], p[few]
            rsd = np.sqrt((res**2).sum(axis=1) / max(1, lookback - 2))
            ends = [symbols.take(pa.array(t[some][keep])) for t in (i, j)]
            yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, (p, slope, intercept, rsd, z[keep]))], names)

    def test_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [x[k].as_py() for x in batch.columns]
                yield from tested(_unpacked([row[:5]] if row[0] == row[5] else [row[:5], row[5:]]))

    r = _blocks(bars, lookback, per_block).mapInArrow(test_blocks, _OUT)
    null = lambda x: F.when(~F.isnan(x), F.col(x))
    return r.withColumns({"p_value": null("p_value"), "z_score": null("z_score")})


def cointegrated_pairs(bars: DataFrame, max_p: float = 0.05, z_entry: float = 2.0, lookback: int = 252, z_window: int = 60, per_block: int = 256, neutral: bool = True) -> DataFrame:
    """Pairs with at least ``lookback`` common bars whose p-value is at most ``max_p``, with the spread z-score. Without
    ``neutral`` only those with a trade: a pair whose spread is within ``z_entry`` is then left out before it is tested."""
    z = c.z_score
    r = tested_pairs(bars, max_p, lookback, z_window, per_block, 0.0 if neutral else z_entry)
    r = (r if neutral else r.filter(F.abs(z) > z_entry)).select("symbol_a", "symbol_b", "p_value", "z_score")
    return r.withColumn("trade", F.when(z > z_entry, "SELL A / BUY B").when(z < -z_entry, "BUY A / SELL B").otherwise("Neutral"))


def pair_signals(pairs: DataFrame, when, z_entry: float = 2.0) -> DataFrame:
    """Two opposite signals per actionable pair, joined by a pair id."""
    p = pairs.filter(c.trade != "Neutral").withColumn("pair_id", F.concat_ws("/", c.symbol_a, c.symbol_b))
    act = F.when(c.trade == "BUY A / SELL B", 1).otherwise(-1)
    side = lambda s, o, a: F.struct(F.col(s).alias("symbol"), F.col(o).alias("other"), a.alias("act"))
    t = p.select("*", F.inline(F.array(side("symbol_a", "symbol_b", act), side("symbol_b", "symbol_a", -act))))
    conv = rnd(F.least(F.lit(1.0), F.abs(c.z_score) / (2 * z_entry)), 2)
    return signal(t, "pair_scanner", c.act, conv, when, {"pair_id": c.pair_id, "pair_symbol": c.other, "trade": c.trade})
