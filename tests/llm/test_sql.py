"""Queries against their SQL on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import connect, rows_of

from llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    cur = connect(sf).execute(Q.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())
