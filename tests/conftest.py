"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores=4, shuffle=4, extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def oracle(spark):
    """Compare a query on the smallest tables with its SQL: columns, rows and values, in any order."""
    import duckdb

    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")

    def norm(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v.item()) if hasattr(v, "item") else str(v)

    def compare(query, sql):
        df = query(spark, str(DATA))
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        order = sorted(df.columns)
        got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
        at = [rel.columns.index(c) for c in order]
        want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
        assert got == want

    return compare
