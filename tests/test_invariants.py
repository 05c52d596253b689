"""What must hold of core queries that no SQL expresses, over whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgrid.operators.vectors import nearest_of_many
from loomgrid.plans import bindings as b
from loomgrid.plans import registry
from loomgrid.plans import search_queries as sq
from tests.conftest import DATA

D, QUERIES = str(DATA), registry.queries()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def code(spark):
    return {r.file: r.content.split("\n") for r in b.sources(spark, D).where("language != 'md'").collect()}


@pytest.mark.parametrize("name", ["extracted_edges", "structure_edges"])
def test_edges_stand_in_their_lines(spark, code, name):
    rows = QUERIES[name](spark, D).collect()
    assert rows and {r.kind for r in rows} <= {"CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "ROUTE"} and {r.file for r in rows} <= set(code)
    for r in rows:
        assert 1 <= r.line <= len(code[r.file])
        if r.kind == "CALLS":
            assert r.source and r.source != r.target
            last = r.target.replace("->", ".").replace("::", ".").split("(")[0].split(".")[-1]
            assert last in "\n".join(code[r.file][r.line - 1 : r.line + 20])


def test_definitions_stand_in_their_lines(spark, code):
    rows = QUERIES["structure_symbols"](spark, D).collect()
    assert len(rows) == len({(r.file, r.line, r.kind, r.name) for r in rows}) > 100
    assert all(r.name in code[r.file][r.line - 1] for r in rows)
    by_line = {(r.file, r.line, r.name) for r in QUERIES["extracted_symbols"](spark, D).collect()}
    both = {(r.file, r.line, r.name) for r in rows if r.kind in ("function", "class", "struct")}
    assert len(both & by_line) >= 0.9 * len(both)


def test_references_stand_in_added_lines(spark):
    from loomgrid.operators.diff import added_lines, parse_diffs

    lines = {(r.file, r.line): [] for r in added_lines(parse_diffs(b.fixes(spark, D))).collect()}
    for r in added_lines(parse_diffs(b.fixes(spark, D))).collect():
        lines[r.file, r.line].append(r.content)
    rows = QUERIES["diff_references"](spark, D).collect()
    assert rows and all(any(r.name in x for x in lines[r.file, r.line]) for r in rows)
    assert max(n for n in QUERIES["diff_references"](spark, D).groupBy("file").count().select("count").toPandas()["count"]) <= 50


def test_replies_give_back_what_they_hold(spark):
    n = {r.review_id: r["count"] for r in b.issues(spark, D).groupBy("review_id").count().collect()}
    got = {r.reply_id: r for r in QUERIES["reply_findings"](spark, D).collect()}
    assert set(got) == set(n)
    for i, r in got.items():
        assert r.n == n[i] if i % 3 else 0 <= r.n <= n[i]
    assert sum(r.n for i, r in got.items() if i % 3 == 0) > 0


def test_hybrid_is_in_order_and_in_its_project(spark):
    rows = QUERIES["hybrid_search"](spark, D).collect()
    ids = {r.id for r in b.symbols(spark, D).where(F.col("project_id") == b.PROJECT).select("id").collect()}
    assert rows and {r.id for r in rows} <= ids and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert all(set(r.signals.split(",")) <= {"fts", "vector", "graph"} for r in rows)


def test_the_index_gives_exact_similarities(spark):
    v = sq._vectors(spark, D)
    exact = {r.id: r.similarity for r in nearest_of_many(v, spark.createDataFrame([(0, sq.QUERY)], "id long, vec array<double>"), 10_000).collect()}
    rows = QUERIES["knn_indexed"](spark, D).collect()
    assert len(rows) == 10 and all(abs(exact[r.id] - r.similarity) < 1e-4 for r in rows)
    assert QUERIES["knn_recall"](spark, D).first().recall >= 0.9
