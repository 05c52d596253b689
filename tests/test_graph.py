"""Graph queries on small graphs."""

from __future__ import annotations

import pytest

from loomgrid.operators import graph as g
from loomgrid.plans import dsl

C = "caller string, callee string, file string, line int, project_id long"
S = "id long, name string, kind string, file string, line int, signature string, language string, project_id long"
E = "source string, kind string, target string, file string, line int, project_id long"


@pytest.fixture
def graph(spark):
    def make(links, project=1):
        return spark.createDataFrame([(a, b, f"{a}.rs", i, project) for i, (a, b) in enumerate(links)], C)

    return make


def test_callers_and_callees(spark, rows, graph):
    c = graph([("x", "target"), ("y", "self.target"), ("y", "self.target"), ("x", "other"), ("z", None)])
    assert rows(g.find_callers(c, "target", 1), "caller") == [("x",), ("y",), ("y",)]
    assert rows(g.find_callees(c, "x", 1), "callee") == [("other",), ("target",)]
    assert g.find_callers(c, "target", 2).count() == 0
    assert g.find_callers(c, "tar_et", 1).count() == 3  # an underscore is a wildcard
    assert g.find_callers(c, "tar\\et", 1).count() == 0


def test_cross_project_fallback(spark, rows, graph):
    c = graph([("a", "f")], 1).unionByName(graph([("b", "f"), ("b", "only2")], 2))
    p = spark.createDataFrame([(1, "/one"), (2, "/two")], "id long, root_path string")
    assert rows(g.callers_or_cross_project(c, p, "f", 1), "caller", "root_path") == [("a", None)]
    assert rows(g.callers_or_cross_project(c, p, "only2", 1), "caller", "root_path") == [("b", "/two")]
    assert rows(g.find_callers_cross_project(c, p, "f"), "caller", "root_path") == [("a", "/one"), ("b", "/two")]


def test_impact_walks_back_and_stops_at_rings(rows, graph):
    c = graph([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")])
    assert rows(g.impact(c, "c", 1, 3), "name", "via", "depth") == [("a", "b", 2), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1)]


def test_trace_prefers_typed_edges(spark, rows, graph):
    c = graph([("a", "b"), ("b", "c"), ("a", "d")])
    none = spark.createDataFrame([], E)
    assert {r[0] for r in rows(g.trace(none, c, "a", 1, 2), "name")} == {"b", "c", "d"}
    e = spark.createDataFrame([("a", "IMPLEMENTS", "t", "f", 1, 1)], E)
    assert rows(g.trace(e, c, "a", 1, 2), "name", "kind") == [("t", "IMPLEMENTS")]
    assert rows(g.trace(none, graph([("a", "c"), ("b", "c")]), "c", 1, 1, outgoing=False), "name") == [("a",), ("b",)]


def test_dead_code(spark, rows, graph):
    names = [("used", "function", ""), ("orphan", "function", ""), ("unused", "method", None), ("test_x", "function", ""), ("new", "function", ""), ("kept", "function", "fn kept() // lint: keep"), ("handle_it", "function", ""), ("fooHandler", "function", ""), ("Thing", "struct", "")]
    s = spark.createDataFrame([(i, n, k, "src/a.rs", i, sig, "rust", 1) for i, (n, k, sig) in enumerate(names)], S)
    c = graph([("m", "used")])
    assert rows(g.dead_code(s, c, 1), "name", "reason") == [("orphan", "no callers found"), ("unused", "no callers found")]
    assert ("test_x",) in rows(g.dead_code(s, c, 1, include_tests=True), "name")
    assert rows(g.dead_code(s, c, 1, entry_points=["OR*"]), "name") == [("unused",)]
    assert {r[0] for r in rows(g.dead_code_in_file(s, c, "src/a.rs", 1), "name")} == {"orphan", "unused", "kept", "handle_it", "fooHandler"}


def test_edge_queries(spark, rows, graph):
    e = spark.createDataFrame([("", "IMPORTS", "os", "a.py", 1, 1), ("", "IMPORTS", "re", "a.py", 2, 1), ("h", "ROUTE", "GET /x/y", "a.py", 3, 1), ("k", "ROUTE", "/plain path", "a.py", 4, 1), ("re", "INHERITS", "Z", "a.py", 5, 1)], E)
    c = spark.createDataFrame([], C)
    assert rows(g.unused_imports(e, c), "target") == [("os",)]
    assert rows(g.list_routes(e), "method", "path") == [("", "/plain path"), ("GET", "/x/y")]
    assert rows(g.list_routes(e, "get", "/x"), "handler") == [("h",)]
    assert rows(g.edge_kind_counts(e, c)) == [("IMPORTS", 2), ("INHERITS", 1), ("ROUTE", 2)]
    assert rows(g.edge_kind_counts(e.where("false"), graph([("a", "b")]))) == [("CALLS", 1)]


def test_affected_tests(spark, rows):
    s = spark.createDataFrame([(1, "seal", "function", "src/box.rs", 1, "", "rust", 1), (2, "t", "function", "tests/box_test.rs", 1, "", "rust", 1)], S)
    c = spark.createDataFrame([("t", "self.seal", "tests/other_spec.rs", 3, 1), ("m", "seal", "src/main.rs", 4, 1)], C)
    changed = spark.createDataFrame([("src/box.rs",)], "file string")
    assert rows(g.affected_tests(s, c, changed)) == [("tests/box_test.rs",), ("tests/other_spec.rs",)]


@pytest.mark.parametrize(("text", "source", "target"), [("A -> *", "A", "*"), ("* -> A", "*", "A"), ("A <- *", "*", "A"), ("A", "*", "A"), ("A -> B", "A", "B"), ("A <- B", "B", "A")])
def test_dsl_parses(text, source, target):
    assert dsl.parse(text) == dsl.Pattern(source, target)


@pytest.mark.parametrize("text", ["", "  ", "-> x", "x ->"])
def test_dsl_refuses(text):
    with pytest.raises(ValueError):
        dsl.parse(text)


def test_dsl_runs(spark, rows, graph):
    c = graph([("a", "b"), ("a", "c")])
    s = spark.createDataFrame([], S)
    assert rows(dsl.run("a -> b", c, s), "name") == [("b",)]
    assert rows(dsl.run("* -> c", c, s), "name") == [("a",)]
