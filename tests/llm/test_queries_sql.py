"""Every SQL text of the training-data operators gives the rows of its query on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import test_queries as core  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

duck = core.duck


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_equals_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, core.SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert core.rows(got.columns, got.collect()) == core.rows(want.columns, want.fetchall())
