"""Queries with an SQL statement of their result, against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracle import duck_connect, rows_of, type_diff  # noqa: E402

from touchpoint.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    duck = duck_connect(SF)
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    assert not type_diff(df.schema, duck, ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rows)
