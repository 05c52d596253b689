"""Orphan references and hierarchies against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgrid.functions.names import bare_name
from loomgrid.operators import hierarchy as hi
from loomgrid.operators import joins
from loomgrid.operators import references as rf

T0 = datetime(2025, 1, 1)
CALLS = "id long, caller string, callee string, file string, line int, project_id long, indexed_at timestamp_ntz, name string, refs string"
SYMBOLS = "id long, name string, project_id long, created_at timestamp_ntz, callee string"


def calls(spark, links):
    """(project, caller, callee, hours); with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, a, b, "f", i, p, T0 + timedelta(hours=h), "x", "y") for i, (p, a, b, h) in enumerate(links)], CALLS)


def symbols(spark, names):
    return spark.createDataFrame([(i, n, p, T0 + timedelta(hours=h), "z") for i, (p, n, h) in enumerate(names)], SYMBOLS)


@pytest.mark.parametrize(("raw", "bare"), [("a", "a"), (" a() ", "a"), ("m::a()", "a"), ("self.x.a", "a"), ("p->a", "a"), ("a::b.c->d()", "d"), ("()", ""), ("", ""), (None, None), ("a.\nb", "\nb")])
def test_bare_name(spark, raw, bare):
    assert spark.createDataFrame([(raw,)], "c string").select(bare_name("c")).first()[0] == bare


def test_orphan_states(spark, rows):
    c = calls(spark, [(1, "m", "a", 5), (1, "m", "x::a()", 1), (1, "m", "gone", 1), (1, "m", " ", 1), (1, "m", None, 1), (None, "m", "a", 9), (2, "m", "a", 9), (1, "m", "gone", 1)])
    s = symbols(spark, [(1, "a", 3), (1, "a", 7), (2, "A", 0), (None, "gone", 0)])
    assert rows(rf.orphan_references(c, s), "call_id", "state") == [(1, "late"), (2, "missing"), (6, "missing"), (7, "missing")]
    periods = rf.orphan_periods(rf.orphan_references(c, s))
    assert {(r.state, r.n_refs, r.n_keys) for r in periods.collect()} == {("late", 1, 1), ("missing", 3, 2)}


def test_orphans_of_empty_tables(spark):
    assert rf.orphan_references(calls(spark, []), symbols(spark, [])).count() == 0
    assert rf.orphan_references(calls(spark, [(1, "a", "b", 0)]), symbols(spark, [])).count() == 1


def test_deltas_fold_like_a_rebuild(spark, rows):
    c = rf.call_references(calls(spark, [(1, "m", n, 1) for n in "aab"]))
    s = symbols(spark, [(1, "a", 0), (1, "b", 0)])
    state = rf.fold_deltas(rf.reference_deltas(c), rf.existence_deltas(s))
    assert rf.orphan_keys(state).count() == 0
    after = rf.fold_deltas(state, rf.existence_deltas(s.where("name = 'a'"), -1))
    assert rows(rf.orphan_keys(after), "name", "refs") == [("a", 2)]
    gone = rf.fold_deltas(after, rf.reference_deltas(c.where("name = 'a'"), -1))
    assert rf.orphan_keys(gone).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(spark, rows, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    monkeypatch.setattr(joins, "HOT_SHARE", 5)
    big = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None) for i in range(300)], "i int, k string")
    small = big.where("k is not null and k != 'k1'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = joins.skew_join(big, small, ["k"], "n", 300, how)
    assert rows(got, "i", "k", "m") == rows(big.join(small.drop("n"), ["k"], how), "i", "k", "m")


def brute(links):
    """node -> (root, depth), ('', -1) on and below rings."""
    parent = dict(links)
    out = {}
    for n in {x for e in links for x in e}:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        out[n] = ("", -1) if x in parent else (x, len(seen))
    return out


def shapes():
    rnd = random.Random(3)
    tree = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 150)]
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 70)]
    star = [(f"s{i}", "hub") for i in range(80)]
    rings = [("a", "b"), ("b", "c"), ("c", "a"), ("below", "a"), ("deeper", "below"), ("self", "self"), ("under", "self"), *[(f"r{i}", f"r{(i + 1) % 17}") for i in range(17)]]
    return {"tree": tree, "chain": chain, "star": star, "rings": rings, "all": tree + chain + star + rings, "none": []}


@pytest.mark.parametrize("shape", list(shapes()))
def test_hierarchy_against_brute_force(spark, shape):
    links = shapes()[shape]
    df = spark.createDataFrame([(1, n, p) for n, p in links] + [(1, n, p) for n, p in links[:3]], "project_id long, node string, parent string")
    h = hi.build_hierarchy(df)
    want = brute(links)
    assert {r.node: (r.root, r.depth) for r in hi.node_roots(h).collect()} == want
    parent = dict(links)
    paths = {r.node: r.path for r in hi.node_paths(h).collect()}
    below = {(r.node, r.descendant): r.steps for r in hi.descendants(h).collect()}
    want_below = {}
    for n, (_, depth) in want.items():
        if depth < 0:
            assert n not in paths
            continue
        up, x = [n], n
        while x in parent:
            x = parent[x]
            up.append(x)
            want_below[x, n] = len(up) - 1
        assert paths[n] == "/".join(reversed(up))
    assert below == want_below
    # A path crosses at most log2(n) chains.
    for r in h.inner.collect():
        assert len(r.segs) <= max(1, len(want)).bit_length()
    on = {r.node: (r.ring, r.ring_size) for r in hi.ring_members(h).collect()}
    expect = {}
    for n in want:
        x, k = parent.get(n), 1
        while x is not None and x != n and k <= len(want):
            x, k = parent.get(x), k + 1
        if x == n:
            ring = [n]
            while parent[ring[-1]] != n:
                ring.append(parent[ring[-1]])
            expect[n] = (min(ring), len(ring))
    assert on == expect


def test_rings_of_several_projects_and_long_rings(spark):
    """Names that repeat across projects, and a ring whose smallest names lie far apart."""
    links = [(1, "a", "c"), (1, "c", "b"), (1, "b", "a"), (2, "b", "b"), (2, "c", "c"), *[(3, f"n{i:02d}", f"n{(i + 1) % 40:02d}") for i in range(40)], *[(4, f"n{i * 17 % 40:02d}", f"n{(i + 1) * 17 % 40:02d}") for i in range(40)]]
    h = hi.build_hierarchy(spark.createDataFrame(links, "project_id long, node string, parent string"))
    got = {(r.project_id, r.node): (r.ring, r.ring_size) for r in hi.ring_members(h).collect()}
    assert got == {(1, x): ("a", 3) for x in "abc"} | {(2, x): (x, 1) for x in "bc"} | {(p, f"n{i:02d}"): ("n00", 40) for p in (3, 4) for i in range(40)}


def test_paths_by_blocks_and_of_asked_nodes(spark, rows, monkeypatch):
    monkeypatch.setattr(hi, "BLOCK", 4)
    links = shapes()["chain"] + shapes()["tree"] + [("x", "c7"), ("y", "x"), ("y2", "x")]
    h = hi.build_hierarchy(spark.createDataFrame([(1, n, p) for n, p in links], "project_id long, node string, parent string"))
    parent = dict(links)

    def spell(n):
        return spell(parent[n]) + "/" + n if n in parent else n

    assert {r.node: r.path for r in hi.node_paths(h).collect()} == {n: spell(n) for e in links for n in e}
    asked = h.nodes.where("name in ('y', 'c31')").select("id")
    assert rows(hi.node_paths(h, asked=asked), "node", "path") == [("c31", spell("c31")), ("y", spell("y"))]


def test_a_deletion_takes_its_time_out_again(spark, rows):
    c = rf.call_references(calls(spark, [(1, "m", "a", 5)]))
    s = symbols(spark, [(1, "a", 3), (1, "a", 7)])
    state = rf.fold_deltas(rf.reference_deltas(c), rf.existence_deltas(s))
    assert rf.late_keys(state).count() == 0
    later = rf.fold_deltas(state, rf.existence_deltas(s.where("id = 0"), -1))
    assert rows(rf.late_keys(later), "name") == [("a",)]
    none = rf.fold_deltas(later, rf.existence_deltas(s.where("id = 1"), -1), rf.reference_deltas(c, -1))
    assert none.count() == 0


def test_call_links_need_a_known_callee_and_a_project(spark, rows):
    c = calls(spark, [(1, "m::a", "b()", 0), (1, "a", "b", 0), (1, "a", "nowhere", 0), (None, "a", "b", 0), (2, "x", "b", 0), (1, None, "b", 0)])
    links = hi.call_links(c, symbols(spark, [(1, "b", 5)]))
    assert rows(links, "project_id", "node", "parent", "n_parents") == [(1, "b", "a", 1)]
    two = hi.call_links(calls(spark, [(1, "z", "b", 0), (1, "a", "b", 0)]), symbols(spark, [(1, "b", 5)]))
    assert rows(two, "parent", "n_parents") == [("a", 2)]


def test_descendants_of_some_nodes(spark, rows):
    df = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "d", "b"), (2, "b", "a")], "project_id long, node string, parent string")
    h = hi.build_hierarchy(df)
    some = h.nodes.where("name = 'b' and project_id = 1").select("id")
    assert rows(hi.descendants(h, some), "node", "descendant", "steps") == [("b", "c", 1), ("b", "d", 1)]
