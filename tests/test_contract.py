"""Driver contract: entry runs; every registered query with reference SQL agrees with DuckDB."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import duck, normalise  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["region_name", "hour", "total_calls"]


def test_keys():
    assert set(E.oracle_sql()) <= set(E.queries())


# The training-data queries have tests of their own, in tests/llm.
OWN = sorted(name for name in E.QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_reference(spark, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    con = duck(SF)
    res = con.execute(sql)
    d_names, d_rows = normalise([c[0] for c in res.description], res.fetchall())
    s_names, s_rows = normalise(df.columns, rows)
    assert s_names == d_names
    assert s_rows == d_rows
