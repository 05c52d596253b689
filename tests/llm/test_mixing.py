"""Mixing: dual, caps, rounding, shares."""

from __future__ import annotations

import math
import random

import pytest

from loomgrid.llm import mixing as m


def tables(spark, seed=1, n=6000):
    rnd = random.Random(seed)
    src = ["big", "mid", "small", "untargeted", None, " Big", "MID"]
    docs = [(i, rnd.choices(src, [60, 20, 5, 10, 2, 2, 1])[0], "x", rnd.randrange(1, 900)) for i in range(n)]
    counts = spark.createDataFrame([(i, s, t) for i, s, _, t in docs], "doc_id long, source string, tokens long").withColumn("source", m.clean_source(m.F.col("source")))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    return counts, targets


@pytest.mark.parametrize("total", [None, 400_000.0])
def test_shares_and_caps(spark, total):
    counts, targets = tables(spark)
    mixed, bal = m.mix(counts, targets, total_tokens=total)
    cap = {"big": 1, "mid": 2, "small": 4}
    rows = mixed.collect()
    assert {r.source for r in rows} == set(cap) and all(0 <= r.copies <= cap[r.source] for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert math.floor(r.rate + 1e-9) <= r.copies <= math.ceil(r.rate - 1e-9) or r.copies in (math.floor(r.rate), math.ceil(r.rate))
    got = {r.source: r for r in m.shares(mixed, bal, targets).collect()}
    for s, want in (("big", 0.5 / 0.95), ("mid", 0.3 / 0.95), ("small", 0.15 / 0.95)):
        assert abs(got[s].reached_share - want) < 0.01
    assert got["absent"].tokens == 0 and abs(sum(g.reached_share for g in got.values()) - 1) < 1e-9
    if total:
        assert abs(sum(g.tokens for g in got.values()) / total - 1) < 0.02


def test_rates_are_exponentially_tilted(spark):
    counts, targets = tables(spark, 2)
    mixed, bal = m.mix(counts, targets)
    for r in mixed.where("source = 'mid'").limit(50).collect():
        assert math.isclose(r.rate, min(2, math.exp(bal.lam["mid"] * r.tokens / bal.mean["mid"])), rel_tol=1e-9)


def test_too_large_a_total_gives_all_copies(spark):
    counts, targets = tables(spark, 3, 500)
    mixed, _ = m.mix(counts, targets, total_tokens=1e12)
    assert mixed.where("source = 'small'").selectExpr("min(copies)").first()[0] == 4


def test_empty(spark):
    counts, targets = tables(spark)
    none, bal = m.mix(counts.where("false"), targets)
    assert none.count() == 0 and m.shares(none, bal, targets).where("tokens > 0").count() == 0
    assert m.mix(counts, targets.where("false"))[0].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Code-File", "hello world", "z"), (2, None, None, "z"), (3, " ", "", "z"), (4, "x", "a" * 200_000, "z")], "doc_id long, source string, text string, tokens string")
    got = {r.doc_id: (r.source, r.tokens) for r in m.token_counts(df).collect()}
    assert got[1] == ("code_file", 2) and got[2] == (None, 0) and got[3] == (None, 0) and got[4][1] > 1000


@pytest.mark.parametrize("total", [1e-9, 1e-3, 50.0, 1e5])
def test_far_multipliers_converge(spark, total):
    """Totals so small that every rate is next to nothing."""
    counts, targets = tables(spark, n=400)
    bal = m.solve(counts, targets, m.Workspace(spark, "test"), total)
    rows = counts.where("tokens > 0").collect()
    for s, lam in bal.lam.items():
        if lam is not None:
            reached = sum(min(math.exp(lam * r.tokens / bal.mean[s]), bal.cap[s]) * r.tokens for r in rows if r.source == s)
            assert abs(reached / bal.goal[s] - 1) < 1e-6


def test_no_convergence_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(m, "STEPS", 1)
    counts, targets = tables(spark, n=200)
    with pytest.raises(RuntimeError):
        m.solve(counts, targets, m.Workspace(spark, "test"), 1e4)
