"""What must hold of text queries that no SQL expresses, over whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import generated, secrets
from loomgrid.llm.queries import QUERIES
from tests.conftest import DATA

D = str(DATA)
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_redacted_texts_hold_no_secret_and_differ_only_there(spark):
    got = QUERIES["p1_redacted"](spark, D).collect()
    found = {(r.table_name, r.row_id) for r in QUERIES["p1_found"](spark, D).collect()}
    assert got and found == {(r.table_name, r.row_id) for r in got}
    texts = {("symbols", r.id): r.signature for r in spark.read.parquet(f"{D}/symbols.parquet").collect()} | {("review_issues", r.id): r.suggested_fix for r in spark.read.parquet(f"{D}/review_issues.parquet").collect()}
    for r in got:
        text = texts[r.table_name, r.row_id]
        assert secrets.scan(r.redacted) == [] and r.redacted.count(secrets.MASK) >= r.n_secrets
        assert all(part in text for part in r.redacted.split(secrets.MASK) for part in [part.strip('"')])


def test_files_come_out_once_and_with_a_kind(spark):
    kinds = QUERIES["p2_kinds"](spark, D).collect()
    found = QUERIES["p2_found"](spark, D).collect()
    assert {(r.project_id, r.path) for r in kinds} == {(r.project_id, r.path) for r in found} and len(found) == len(kinds) == len({tuple(r) for r in found})
    assert {r.kind for r in kinds} <= set(generated.KINDS)
    files = {(r.project_id, r.path) for r in spark.read.parquet(f"{D}/files.parquet").collect()}
    assert {(r.project_id, r.path) for r in found} <= files


def test_validation_counts_add_up(spark):
    for r in QUERIES["p2_validation"](spark, D.replace("sf0.001", "sf0.01")).collect():
        assert r.n_signed <= r.n_files and 0 <= r.precision <= 1 and 0 <= r.recall <= 1
        assert r.mode != "plain" or (r.recall >= 0.9 and r.precision >= 0.9)


def test_reasons_and_rates_count_the_found_values(spark):
    found = QUERIES["p6_found"](spark, D)
    n = found.count()
    assert n == found.distinct().count() == QUERIES["p6_reasons"](spark, D).agg(F.sum("count")).first()[0] == QUERIES["p6_rates"](spark, D).agg(F.sum("n_cut")).first()[0]
    assert QUERIES["p6_rates"](spark, D).where("n_cut > n_values or abs(share - n_cut / n_values) > 1e-9").count() == 0


def test_planted_copies_are_found(spark):
    r = QUERIES["p6_recall"](spark, D).agg(F.sum("n_planted").alias("n"), F.sum("n_found").alias("m")).first()
    assert r.n > 50 and r.m >= 0.9 * r.n


def test_edited_items_are_found(spark):
    r = QUERIES["p7_recall"](spark, D).agg(F.sum("n_planted").alias("n"), F.sum("n_found").alias("m")).first()
    assert r.n > 100 and r.m >= 0.9 * r.n
    exact = {(r.item_id, r.doc_id) for r in QUERIES["p7_found"](spark, D).collect()}
    near = QUERIES["p7_near"](spark, D).collect()
    assert all(r.edits >= 0 for r in near) and all((r.item_id, r.doc_id) in exact for r in near if r.edits == 0)


def test_mix_keeps_its_caps_and_shares(spark):
    mix = QUERIES["p8_mix"](spark, D)
    caps = {r.source: r for r in spark.read.parquet(f"{D}/mix_targets.parquet").collect()}
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = mix.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    size: dict[str, int] = {}
    for r in rows:
        assert 1 <= r.copies <= caps[r.source].max_repeats and r.doc_id in docs and r.tokens >= 0
        size[r.source] = size.get(r.source, 0) + r.copies * r.tokens
    total = sum(size.values())
    shares = {r.source: r for r in QUERIES["p8_shares"](spark, D).collect()}
    assert set(shares) == set(caps)
    real = [c for c in shares if size.get(c)]
    goal = sum(caps[s].target_share for s in real)
    for s in real:
        assert abs(size[s] / total - caps[s].target_share / goal) < 0.05


def test_stretches_are_equal_and_cover_the_pairs(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    spans = QUERIES["p9_spans"](spark, D).collect()
    assert {(r.doc_a, r.doc_b) for r in spans} == {(r.doc_a, r.doc_b) for r in QUERIES["p9_found"](spark, D).collect()}
    for r in spans:
        a, b = text[r.doc_a], text[r.doc_b]
        assert r.length >= 400 and a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length]
        # Whole stretches: they go on at neither end.
        assert r.start_a == 0 or r.start_b == 0 or a[r.start_a - 1] != b[r.start_b - 1]
        assert a[r.start_a + r.length : r.start_a + r.length + 1] != b[r.start_b + r.length : r.start_b + r.length + 1] or r.start_a + r.length == len(a) or r.start_b + r.length == len(b)
