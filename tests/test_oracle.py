"""Every query of the core with SQL against DuckDB on the smallest tables; the others run and give a stable schema."""

from __future__ import annotations

import pytest

from loomgrid.plans import registry
from tests.conftest import DATA

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(oracle, name):
    oracle(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test data")
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= 0
