"""Leaking evaluation texts against brute force, and recall under edits."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomgrid.llm import leakage as k

VOC = [f"w{i}" for i in range(400)]


def corpus(seed):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choice(VOC) for _ in range(rnd.choice([5, 12, 30])))) for i in range(25)]
    docs = []
    for i in range(120):
        w = [rnd.choice(VOC) for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.6:
            p = rnd.choice(items)[1].split()
            a = rnd.randrange(len(p))
            w += p[a : a + rnd.randrange(8, 25)]
        docs.append((i, rnd.choice([" ", ", ", "\n- "]).join(w).upper()))
    return items, docs


def brute(items, docs, n=12):
    out = set()
    for i, p in items:
        a = k.words(p)
        for d, t in docs:
            w = k.words(t)
            grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if any(tuple(a[j : j + n]) in grams for j in range(len(a) - n + 1)):
                out.add((i, d))
    return out


def frames(spark, items, docs):
    return spark.createDataFrame([(i, "s", p, "x") for i, p in items], "item_id long, suite string, passage string, text string"), spark.createDataFrame([(d, t, "y") for d, t in docs], "doc_id long, text string, passage string")


def test_equals_brute_force(spark, monkeypatch):
    items, docs = corpus(1)
    items += [(90, None), (91, ""), (92, items[2][1])]
    docs += [(900, None), (901, ""), (902, docs[3][1])]
    i, d = frames(spark, items, docs)
    want = brute(items, docs)
    assert {(r.item_id, r.doc_id) for r in k.leak_matches(d, i).collect()} == want
    monkeypatch.setattr(k, "ITEM_CHARS", 500)  # many blocks
    got = k.leak_matches(d, i)
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == sorted(want)
    assert {r.item_id for r in k.leaked_items(got, i).collect()} == {x for x, _ in want}


def test_empty(spark):
    i, d = frames(spark, [], [])
    assert k.leak_matches(d, i).count() == 0


def test_edited_items_reach_the_recall():
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice(VOC) for _ in range(40))) for i in range(60)]
    ix = k.build_index(items, None, 0.1, 0.95)
    hit = 0
    for i, p in items:
        w = p.split()
        for _ in range(3):
            j = rnd.randrange(len(w))
            w[j : j + rnd.randrange(2)] = [rnd.choice(VOC)]
        text = " ".join([rnd.choice(VOC) for _ in range(50)] + w + [rnd.choice(VOC) for _ in range(50)])
        got = [m for m in k.match(ix, text) if m[0] == i]
        assert all(m[3] <= 4 for m in got)
        hit += bool(got)
    assert hit >= 0.9 * len(items)


def test_embedding_keeps_equal_rows_equal():
    x = np.random.default_rng(1).integers(1, 50, (20, 12))
    assert (k.cgk(x, 3) == k.cgk(x.copy(), 3)).all() and not (k.cgk(x, 3) == k.cgk(x, 4)).all()
    y = x.copy()
    y[:, 5] = 99
    assert (k.cgk(x, 3) != k.cgk(y, 3)).mean() < 0.75


def test_edit_distance():
    assert k.edit_distance([1, 2, 3], [9, 1, 2, 3, 9], 2) == 0
    assert k.edit_distance([1, 2, 3], [1, 3], 2) == 1
    assert k.edit_distance([1, 2, 3], [7, 8], 1) == 2


@pytest.mark.parametrize("n", [29, 38])
def test_a_length_with_one_passage_reaches_the_recall(n):
    import random

    r = random.Random(n)
    passage = [f"w{n}x{i}" for i in range(n)]
    ix = k.build_index([(1, " ".join(passage))], None, 0.1, 0.95)
    found = 0
    for _ in range(100):
        c = list(passage)
        for p in r.sample(range(n), n // 10):
            c[p] = passage[(p + 7) % n]
        found += bool(k.match(ix, " ".join(c)))
    assert found >= 0.9 * 100


def test_recall_out_of_reach_is_an_error():
    with pytest.raises(ValueError):
        k.build_index([(1, " ".join(f"w{i}" for i in range(60)))], None, 0.1, 0.95, most_reps=0)


def test_windows_with_an_edit_equal_brute_force():
    items, docs = corpus(5)
    ix = k.build_index([(i, p) for i, p in items], 12, 1 / 12, 0.97)
    want = hit = 0
    for d, t in docs:
        w = k.words(t)
        got = {(m[0], m[1]): m[3] for m in sorted(k.match(ix, t), key=lambda m: -m[3])}
        for i, p in items:
            a = k.words(p)
            for j in range(len(a) - 11):
                e = k.edit_distance([ix.vocab[x] for x in a[j : j + 12]], [ix.vocab.get(x, 0) for x in w], 1)
                assert ((i, j) in got) <= (e <= 1)
                assert (e == 0) == (got.get((i, j)) == 0)
                want, hit = want + (e == 1), hit + (e == 1 and (i, j) in got)
    assert want > 20 and hit >= 0.9 * want


def test_a_copy_at_the_end_may_lack_its_last_words():
    items = [(1, " ".join(VOC[:40]))]
    ix = k.build_index(items, None, 0.1, 0.95)
    assert [m[0] for m in k.match(ix, " ".join(VOC[100:110] + VOC[:38]))][:1] == [1]
    assert not k.match(ix, " ".join(VOC[:30]))


def test_long_texts_walk_in_parts(monkeypatch):
    monkeypatch.setattr(k, "WALK", 7)
    p = [" ".join(VOC[i : i + 30]) for i in range(0, 90, 30)]
    ix = k.build_index(list(enumerate(p)), 12, 1 / 12, 0.95)
    got = k.match_all(ix, [" x ".join(p), None, "", " ".join(VOC[5:25])])
    assert {m[0] for m in got[0]} == {0, 1, 2} and not got[1] and not got[2] and {m[:2] for m in got[3] if m[3] == 0} == {(0, j) for j in range(5, 14)}


def test_recall_of_planted_copies(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(VOC) for _ in range(rnd.choice([20, 30, 40])))) for i in range(30)] + [(40, None), (41, ""), (42, "one two")]
    i = spark.createDataFrame(rows, "item_id long, passage string")
    got = k.recall_of(i).collect()
    assert {r.n_words for r in got} == {2, 20, 30, 40} and sum(r.n_found for r in got) >= 0.9 * sum(r.n_planted for r in got)
