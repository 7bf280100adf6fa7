"""One forest per symbol."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import forests, learn, portfolio

D0 = dt.date(2021, 1, 1)
SCHEMA = "symbol string, date date, close double, " + ", ".join(f"{f} double" for f in learn.FEATURES) + ", target int"


@pytest.fixture(scope="module")
def table(spark):
    """A follows its third feature, B is noise, C always rises, D has one row."""
    r, rows = np.random.RandomState(1), []
    for s, n in (("A", 300), ("B", 200), ("C", 50), ("D", 1)):
        for i in range(n):
            x = r.normal(0, 1, len(learn.FEATURES))
            y = int(x[2] > 0.1) if s == "A" else int(r.rand() > 0.5) if s == "B" else 1
            rows.append((s, D0 + dt.timedelta(days=i), 10.0 + i, *map(float, x), y))
    return learn.chronological(spark.createDataFrame(rows, SCHEMA)).cache()


def test_each_symbol_has_its_own_forest(table):
    p = forests.fit_predict_by_symbol(table, trees=30).cache()
    rows = p.collect()
    assert all(0 <= r.probability <= 1 and r.prediction == int(r.probability > 0.5) for r in rows)
    got = {r.symbol: r for r in learn.evaluate(p).collect()}
    assert {s: e.n for s, e in got.items()} == {"A": 60, "B": 40, "C": 10, "D": 1} or {s: e.n for s, e in got.items()} == {"A": 60, "B": 40, "C": 10}
    assert got["A"].accuracy > 0.9 and got["C"].accuracy == 1.0 and got["B"].accuracy < 0.8
    alone = {r.date: r.probability for r in forests.fit_predict_by_symbol(table.filter("symbol = 'A'"), trees=30).collect()}
    assert alone == {r.date: r.probability for r in rows if r.symbol == "A"}
    assert {r.symbol for r in portfolio.strategy_vs_hold(p, "prediction").collect()} == set(got)


def test_trees_fit_what_their_depth_can_part():
    r = np.random.RandomState(0)
    x = r.normal(0, 1, (400, 8))
    y = ((x[:, 0] > 0) & (x[:, 5] > 0)).astype(float)
    assert ((forests.Forest(x, y, 50, 8, r).probability(x) > 0.5) == (y > 0)).mean() > 0.97
    assert (forests.Forest(x, np.ones(400), 5, 5, r).probability(x) == 1.0).all()
    flat = forests.Forest(np.zeros((50, 8)), (np.arange(50) % 2).astype(float), 40, 5, r).probability(np.zeros((3, 8)))
    assert len(set(flat.tolist())) == 1 and 0.3 < flat[0] < 0.7  # nothing parts equal rows


def test_one_tree_without_sampling_is_the_best_cut():
    x = np.repeat(np.arange(10.0), 5)[:, None]
    y = (x[:, 0] > 6).astype(float)
    f = forests.Forest(x, y, 20, 1, np.random.RandomState(3))
    assert all(abs(f.cuts[0][k] - 6.5) < 1.01 for k in f.levels[0][1][:, 0])
    assert set((f.probability(np.array([[0.0], [9.0]])) > 0.5).tolist()) == {False, True}


def test_no_rows(table):
    assert forests.fit_predict_by_symbol(table.limit(0)).count() == 0


def test_only_the_features_in_turn_are_counted(monkeypatch):
    """A level's histogram holds the first few features of each node, not all of them; the trees are the same."""
    r = np.random.RandomState(2)
    x, y = r.normal(0, 1, (300, 8)), (r.rand(300) > 0.5).astype(float)
    sizes, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda v, *a, **k: sizes.append(len(v)) or count(v, *a, **k))
    f = forests.Forest(x, y, 20, 4, np.random.RandomState(7))
    assert max(sizes) <= 20 * 300 * 2  # two of eight features, no row twice
    assert all((k[0] < 8).all() and (k[1] < forests.BINS).all() for k in f.levels) and (f.levels[0][0] >= 0).all()


def test_rolling_hurst_is_plain_arithmetic(spark):
    """No interpreted lambda for each bar, and the condition on complete rows does not compute the slope again."""
    from tickloom.operators import risk

    days = [("A", D0 + dt.timedelta(days=i), 10.0 + (i * 7 % 5)) for i in range(60)]
    bars = spark.createDataFrame(days, "symbol string, date date, close double")
    assert "lambdafunction" not in risk.rolling_hurst(bars)._jdf.queryExecution().optimizedPlan().toString()
    plan = learn.feature_table(bars.withColumns({"rsi_14": bars.close, "macd_hist": bars.close}))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and not any("ln(" in line or "LOG(" in line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter") and "_s2" in line)
    xs, ys = np.log([2, 3, 4]), [0.3, 0.9, 0.2]
    one = spark.createDataFrame([(*ys,), (0.3, None, 0.2), (None, None, 0.2)], "a double, b double, c double")
    got = [r.s for r in one.select(risk._slope(list(map(float, xs)), [one.a, one.b, one.c]).alias("s")).collect()]
    assert got[0] == pytest.approx(np.polyfit(xs, ys, 1)[0]) and got[1] == pytest.approx((0.2 - 0.3) / (xs[2] - xs[0])) and got[2] is None


def test_the_pooled_forest_keeps_nothing_per_row_and_tree(spark, table, monkeypatch):
    """However its rows are dealt the forest is the same, its rows are written once, and nothing is cached; it parts what a rule parts."""
    from tickloom.operators import pooled_forest

    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    of = lambda t: {(r.symbol, r.date): (r.prediction, r.probability) for r in learn.fit_predict(t, trees=20).collect()}
    got = of(table.filter("symbol <> 'C'").repartition(5))
    assert got == of(table.filter("symbol <> 'C'").coalesce(1)) and len(spark.sparkContext._jsc.getPersistentRDDs()) == kept
    target = {(r.symbol, r.date): r.target for r in table.collect()}
    assert len(got) == 101 and sum(got[k][0] == target[k] for k in got if k[0] == "A") > 50
    assert learn.fit_predict(table.filter("symbol = 'D'")).count() == 0 == learn.fit_predict(table.limit(0)).count()
    r = np.random.RandomState(0)
    rows = [(i, *map(float, x), int(x[0] > 0 and x[1] > 0)) for i, x in enumerate(r.normal(0, 1, (2000, 2)))]
    t = spark.createDataFrame(rows, "id long, a double, b double, y int")
    f = pooled_forest.grow(t, ["a", "b"], "y", t.id, 10, 3, 1)
    assert ((f.probability(np.array(rows)[:, 1:3]) > 0.5) == (np.array(rows)[:, 3] == 1)).mean() > 0.97
    weights = np.array(list(pooled_forest.weights(r.randint(0, 2**62, 4000), 10, 3)))
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05 and abs(np.corrcoef(weights)[0, 1:]).max() < 0.06


def test_leaves_that_vote_alike_are_one():
    from tickloom.operators import pooled_forest

    leaves = np.array([[[3.0, 1], [5, 1], [1, 4], [9, 2]], [[0, 5], [0, 0], [1, 2], [0, 4]]])
    got = pooled_forest.merged(leaves)
    assert got[0].tolist() == [[8, 2], [8, 2], [1, 4], [9, 2]] and got[1].tolist() == [[1, 11]] * 4


def test_cuts_are_the_best_of_the_features_in_turn():
    """Levels by hand: each node's cut has the least Gini impurity of the features it looks at, the first of equal ones."""
    r = np.random.RandomState(11)
    x, y = np.round(r.normal(0, 1, (120, 4)), 1), (r.rand(120) > 0.4).astype(float)
    trees, depth = 6, 3
    f = forests.Forest(x, y, trees, depth, np.random.RandomState(5))
    again, b = np.random.RandomState(5), forests.binned(x, f.cuts)
    rows, node = again.randint(0, 120, (trees, 120)), np.zeros((trees, 120), int)
    for level in range(depth):
        turns = again.rand(trees, 1 << level, 4).argsort(axis=2)
        for t in range(trees):
            for k in range(1 << level):
                some = rows[t][node[t] == k]
                want = (-1, 0)
                for first in (0, 2):
                    found = []
                    for j in sorted(turns[t, k, first : first + 2]):
                        for cut in range(forests.BINS):
                            sides = [y[some[b[some, j] <= cut]], y[some[b[some, j] > cut]]]
                            if all(map(len, sides)) and 0 < y[some].mean() < 1:
                                found.append((sum(s.sum() * (len(s) - s.sum()) / len(s) for s in sides) + 121.0 * (first // 2), j, cut))
                    if found:
                        want = min(found)[1:]
                        break
                assert (f.levels[level][0][t, k], f.levels[level][1][t, k]) == want
        feature, cut = (v[np.arange(trees)[:, None], node] for v in f.levels[level])
        node = 2 * node + ((feature >= 0) & (b[rows, np.maximum(feature, 0)] > cut))


def test_bins_are_read_where_they_lie(spark, table):
    """No copy of a row's bins for each tree, and a symbol's rows stay in Arrow."""
    import tracemalloc

    r = np.random.RandomState(2)
    x, y = r.normal(0, 1, (400, 8)), (r.rand(400) > 0.5).astype(float)
    tracemalloc.start()
    f = forests.Forest(x, y, 100, 5, r)
    fit = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    f.probability(x)
    predicted = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fit < 9e6 and predicted < 3e6
    plan = forests.fit_predict_by_symbol(table)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
