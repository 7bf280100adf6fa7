"""Direction features, classifier and its evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recur, ts
from ..functions.num import c, sdiv
from . import pooled_forest
from .risk import rolling_hurst
from .strategies import went_up

FEATURES = ["return_1d", "return_5d", "return_10d", "rsi_14", "macd_hist", "vol_20d", "hurst_20", "deliv_pct"]


def feature_table(panel: DataFrame) -> DataFrame:
    """Features and next-day target of every bar of every symbol, complete rows only.

    Without an ``rsi_14`` column the simple-mean form gain / (loss + 1e-9) is used; without ``macd_hist`` the difference of
    exponential means that start at the first bar.
    """
    b = panel.withColumns({f"return_{n}d": ts.pct_change(c.close, n) for n in (1, 5, 10)}).withColumn("_lr", ts.log_return(c.close))
    if "rsi_14" not in panel.columns:
        d = ts.diff(c.close)
        b = b.withColumns({"_g": F.greatest(d, F.lit(0.0)), "_l": F.greatest(-d, F.lit(0.0))})
        b = b.withColumn("rsi_14", 100 - 100 / (1 + ts.mean(F.col("_g"), 14) / (ts.mean(F.col("_l"), 14) + 1e-9)))
    if "macd_hist" not in panel.columns:
        b = _macd_from_first_bar(b)
    if "deliv_pct" not in panel.columns:
        b = b.withColumn("deliv_pct", F.lit(0.0))
    b = rolling_hurst(b.withColumns({"vol_20d": ts.std(F.col("_lr"), 20), "target": went_up()}))
    # hurst_20 and target always have a value; a condition on them would compute them twice
    return b.select("symbol", "date", "close", *FEATURES, "target").na.drop(subset=["symbol", "date", "close", *[f for f in FEATURES if f != "hurst_20"]])


def _macd_from_first_bar(b: DataFrame, fast: int = 12, slow: int = 26, sig: int = 9) -> DataFrame:
    """MACD histogram of exponential means whose first value is the first close (no seeding window)."""
    had = b.columns
    spec = lambda x, n: (recur.seeded(x, 0, 2.0 / (n + 1), x), 1 - 2.0 / (n + 1))
    b = recur.decay_sums(recur.with_blocks(b), {"_ef": spec(c.close, fast), "_es": spec(c.close, slow)})
    b = b.withColumn("_mac", F.col("_ef") - F.col("_es"))
    b = recur.decay_sums(b, {"_sg": spec(F.col("_mac"), sig)})
    return b.withColumn("macd_hist", F.col("_mac") - F.col("_sg")).select(*had, "macd_hist")


def chronological(t: DataFrame, share: float = 0.8) -> DataFrame:
    """Mark the first ``share`` of each symbol's rows as training rows."""
    return ts.position(t).withColumn("is_train", c.bn < F.floor(c.n_bars * share)).drop("bn", "n_bars")


def fit_predict(t: DataFrame, trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """Random forest fitted on the training rows of all symbols, predictions for the rest; none without training rows.

    A row is told from others by its symbol and date. The forest passes over its training rows once a level.
    """
    key = F.xxhash64("symbol", "date")
    m = t.sparkSession.sparkContext.broadcast(pooled_forest.grow(t.filter("is_train"), FEATURES, "target", key, trees, depth, seed))

    @F.pandas_udf("double")
    def probability(*cols: pd.Series) -> pd.Series:
        return pd.Series(m.value.probability(np.column_stack([x.to_numpy(float) for x in cols])))

    rest = t.filter(~c.is_train) if m.value else t.limit(0)
    p = rest.select("symbol", "date", "close", "target", probability(*FEATURES).alias("probability"))
    return p.select("symbol", "date", "close", "target", (c.probability > 0.5).cast("int").alias("prediction"), "probability")


def evaluate(p: DataFrame) -> DataFrame:
    """Accuracy, precision and recall per symbol; a zero denominator gives 0."""
    n = lambda cond: F.count_if(cond)
    g = p.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), n(c.prediction == c.target).alias("hit"), n((c.prediction == 1) & (c.target == 1)).alias("tp"),
        n(c.prediction == 1).alias("pp"), n(c.target == 1).alias("ap"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return g.select("symbol", "n", (c.hit / c.n).alias("accuracy"), zero(sdiv(c.tp, c.pp)).alias("precision"), zero(sdiv(c.tp, c.ap)).alias("recall"))
