"""Every registered query against its DuckDB oracle on the driver tables."""

import os

import pytest

import __spark_entry__ as entry
from fxledger.plans.oracle import oracle_sql
from fxledger.plans.queries import queries
from oracle_check import compare, duck

SF_DIR = os.environ.get("FXLEDGER_TEST_SF", "/root/testdata/sf0.001")
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) == set(queries())
    assert set(queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    compare(spark, con, queries()[name], oracle_sql()[name], SF_DIR)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "price", "date"]
    assert df.count() > 0
