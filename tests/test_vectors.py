"""The stored indexes of vectors and symbols against exact search."""

from __future__ import annotations

import numpy as np
import pytest

from loomgrid.functions.text import code_tokens, embed, embed_udf
from loomgrid.operators import search
from loomgrid.operators import vectors as v
from loomgrid.operators.symbol_index import SymbolIndex

V = "id long, vec array<float>"


def cloud(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims)) * 2
    x = centers[rng.integers(12, size=n)] + rng.normal(size=(n, dims))
    return [(i, r.astype(np.float32).tolist()) for i, r in enumerate(x)]


def test_index_reaches_its_recall_and_survives_changes(spark, rows, tmp_path):
    data = cloud(1500)
    bad = [(9000, [1.0]), (9001, [0.0] * 16), (9002, None), (None, [1.0] * 16), (9003, [None] + [1.0] * 15)]
    df = spark.createDataFrame(data + bad, V)
    ix = v.VectorIndex.build(df, str(tmp_path / "ix"), 16)
    assert ix.vectors().count() == 1500 and 1 <= ix.lists.probes < len(ix.lists.centroids)
    asked = df.where("id % 50 = 0")
    exact = v.nearest_of_many(df, asked, 10)
    r = v.recall(ix.search_many(asked, 10), exact).first()
    assert r.n_queries == 30 and r.n_exact == 300 and r.recall >= 0.9
    x = np.array([a for _, a in data], np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    for q in (0, 50, 1450):
        want = np.argsort(-(x @ x[q]), kind="stable")[:10].tolist()
        assert [a.id for a in exact.where(f"query = {q}").orderBy("similarity", ascending=False).collect()] == want
    again = v.VectorIndex.open(spark, str(tmp_path / "ix"))
    assert again.lists.probes == ix.lists.probes and np.array_equal(again.lists.centroids, ix.lists.centroids)
    far = [50.0] + [0.0] * 15
    again.upsert(spark.createDataFrame([(7, far, 1), (7, data[8][1], 0), (5000, far, 1)], V + ", seq int"), order="seq")
    assert again.vectors().count() == 1501 and [a.id for a in again.search(far, 2).collect()] == [7, 5000]
    again.remove(spark.createDataFrame([(7,), (12345,)], "id long"))
    assert again.vectors().count() == 1500 and [a.id for a in again.search(far, 1).collect()] == [5000]
    assert rows(again.search(far, 3, members=spark.createDataFrame([(1,), (2,)], "id long")), "id") == [(1,), (2,)]
    assert again.search([1.0], 3).count() == 0


def test_empty_and_equal_vectors(spark, tmp_path):
    none = spark.createDataFrame([], V)
    ix = v.VectorIndex.build(none, str(tmp_path / "a"), 4)
    assert ix.search([1.0, 0.0, 0.0, 0.0], 3).count() == 0 and ix.search_many(none, 3).count() == 0 and v.recall(ix.search_many(none, 3), v.nearest_of_many(none, none, 3)).first().recall == 1.0
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], V)
    got = v.nearest_of_many(ties, ties.where("id = 5"), 3).collect()
    assert sorted(r.id for r in got) == [0, 1, 2] and all(abs(r.similarity - 1) < 1e-6 for r in got)


@pytest.fixture
def symbols(spark):
    names = ["parseQuery", "parse_tree", "sealToken", "open_file", None, "queueConsumer", "retryPolicy", "walkTree"]
    rows = [(i, i % 3 or None, names[i % 8] and f"{names[i % 8]}{i}", "function", f"src/f{i % 5}.rs", i, None if i % 7 == 0 else f"pub fn {names[i % 8]}(a: u32)", "rust", "x") for i in range(80)]
    return spark.createDataFrame(rows, "id long, project_id long, name string, kind string, file string, line int, signature string, language string, doc string")


def test_symbol_index_gives_what_scans_give(spark, symbols, tmp_path):
    edges = spark.createDataFrame([(i, "parseQuery1", "CALLS", f"walkTree{i}", "f", 1, 1) for i in range(7, 60, 8)], "id long, source string, kind string, target string, file string, line int, project_id long")
    ix = SymbolIndex.build(symbols, str(tmp_path / "ix"))
    for text, project in (("pub fn src", 1), ("parseQuery", None), ("alkTre", None), ("nothing_at_all", 2), ("!!", 1)):
        want = [(r.id, round(r.score, 9)) for r in search.search(symbols, text, project).collect()]
        assert [(i, round(x, 9)) for i, x in ix.search(text, project)] == want
    vec = symbols.selectExpr("id", "project_id", "case when coalesce(signature, '') = '' then name else concat_ws(' ', name, signature) end as t").where("project_id = 1").select("id", embed_udf("t").alias("vec"))
    q = embed(code_tokens("parse tree")).tolist()
    a = search.hybrid(symbols, edges, vec, "pub fn", q, 1, 10).collect()
    b = ix.hybrid(edges, "pub fn", q, 1, 10).collect()
    assert [(r.id, round(r.score, 9), r.signals) for r in a] == [(r.id, round(r.score, 9), r.signals) for r in b] and a
    changed = symbols.where("id != 3").selectExpr("id", "project_id", "name", "kind", "file", "line", "case when id = 5 then 'fn other()' else signature end as signature", "language")
    assert ix.refresh_vectors(changed) == 1 and ix.refresh_vectors(changed) == 0 and ix._table("vectors").count() == 79


def test_nearest_is_knn(spark):
    df = spark.createDataFrame(cloud(300) + [(900, None), (901, [0.0] * 16), (902, [1.0])], V)
    q = cloud(1, seed=5)[0][1]
    for k in (0, 1, 7, 1000):
        a, b = v.nearest(df, q, k).collect(), search.knn(df, q, k).collect()
        assert [r.id for r in a] == [r.id for r in b] and all(abs(x.similarity - y.similarity) < 1e-5 for x, y in zip(a, b, strict=True))
    assert v.nearest(df, [0.0] * 16, 3).count() == 0 and v.nearest(df.where("false"), q, 3).count() == 0
