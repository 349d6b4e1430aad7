from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import TESTDATA
from tests.oracle_check import compare, connect

SMALL = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, oracle) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
