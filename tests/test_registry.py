"""Layer 3: every registered query equals its DuckDB oracle (sf0.001 here; the driver uses sf0.01)."""

import pytest

import __spark_entry__ as entry
from conftest import SF001
from oracle_check import compare, duck

# Queries of the optional subpackage that SQL cannot state are tested with that subpackage.
NAMES = sorted(entry.oracle_sql())


def test_every_query_has_an_oracle():
    assert set(entry._registry()) <= set(NAMES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "batch_total_stock" in df.columns


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF001, con)
    assert r["ok"], r
