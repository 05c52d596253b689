"""Every text query with SQL against DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import pytest

from loomgrid.llm.queries import QUERIES
from loomgrid.llm.sql import SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(oracle, name):
    oracle(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test data")
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= 0
