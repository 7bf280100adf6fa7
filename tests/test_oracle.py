"""Registered queries against their SQL.  All of them with TICKLOOM_FULL=1, a spread of families otherwise."""

import os

import pytest

from __spark_entry__ import CATALOG, entry, oracle_sql, queries
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SPREAD = [
    "w2_rolling_full", "w7_percent_rank", "w12_linreg", "w14_resample", "t4_macd", "t8_adx", "c4_car_rating", "v10_vcp", "v12_supertrend", "v13_candles",
    "r1_max_drawdown", "r4_beta", "r11_correlation_matrix", "z7_rule_positions", "p6_strategy_report", "a12_top_per_category", "j3_delivery_asof", "s9_candle_arrays",
    "s14_contract_master", "q11_back_adjust", "x4_darvas", "x13_rotation", "k7_snapshot_delta", "e1_action_tags",
]
NAMES = list(CATALOG) if os.environ.get("TICKLOOM_FULL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, msg = compare(spark, con, SF, CATALOG[name])
    assert ok, msg


def test_entry_and_contract(spark):
    df = entry(spark)
    assert df.count() == 10 and "trend_status" in df.columns
    assert set(oracle_sql()) <= set(queries())
