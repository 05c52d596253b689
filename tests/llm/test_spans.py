"""Shared spans against brute force over all windows."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from loomgrid.llm import spans as sp

SCHEMA = "doc_id long, text string, doc long, key long, c int"


def brute(docs, size):
    at = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - size + 1):
            at[t[k : k + size]].add(i)
    return {(a, b) for v in at.values() for a in v for b in v if a < b}


def corpus(seed, n, alphabet="abcdefgh \nλ"):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    shared = [text(rnd.randrange(30, 130)) for _ in range(8)]
    docs = []
    for i in range(n):
        t = text(rnd.randrange(0, 200))
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            a = rnd.randrange(len(s) // 2)
            t += s[a : a + rnd.randrange(20, 120)] + text(rnd.randrange(40))
        docs.append((i, t))
    return docs


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "abcdefgh \nλ"), (2, "ab"), (3, "a"), (4, "abc\U0001f600")])
@pytest.mark.parametrize("block", [2000, 5])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, alphabet, block):
    monkeypatch.setattr(sp, "BLOCK", block)
    docs = corpus(seed, 60, alphabet)
    docs += [(100, docs[7][1]), (101, None), (102, ""), (103, "ab" * 300), (104, "x" + "ab" * 90 + "y"), (105, "abc" * 100)]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in docs], SCHEMA)
    got = sp.shared_spans(df, min_chars=50, k=30)
    assert {tuple(r) for r in sp.span_pairs(got).collect()} == brute(docs, 50)
    text = dict(docs)
    for r in got.collect():
        assert r.length >= 50 and text[r.doc_a][r.start_a : r.start_a + r.length] == text[r.doc_b][r.start_b : r.start_b + r.length]


def test_every_stretch_lies_in_the_window_of_its_smallest_hash():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        h = rnd.integers(0, 1 << 60, 80).astype(np.uint64)
        win = {(lo, c, r) for lo, c, r, _ in sp.compact_windows(h, 10)}
        for a in range(80):
            for b in range(a + 10, 81):
                c = a + int(h[a:b].argmin())
                assert any(lo <= a and b - 1 <= r and x == c for lo, x, r in win)
    assert len(sp.compact_windows(rnd.integers(0, 1 << 60, 100_000).astype(np.uint64), 100)) < 3 * 100_000 / 100


def test_gram_hashes_depend_on_content_only():
    a = sp._codes("xxhello worldyy")
    b = sp._codes("hello world" * 500)
    assert sp.gram_hashes(a, 11)[2] == sp.gram_hashes(b, 11)[0] == sp.gram_hashes(b, 11)[11 * 499]
    assert len(sp.gram_hashes(a, 16)) == 0


def test_portions(spark):
    x, y = "".join(chr(97 + i % 26 + (i // 26) % 3) for i in range(120)), "q" * 10 + "".join(chr(65 + (i * i) % 57) for i in range(100))
    docs = [(1, x + y), (2, x), (3, y), (4, "alone" * 30)]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in docs], SCHEMA)
    got = {r.doc_id: r for r in sp.shared_portion(sp.shared_extents(df, min_chars=60, k=40), df).collect()}
    assert set(got) == {1, 2, 3} 
    assert 0.9 < got[2].portion <= 1 and 0.9 < got[1].portion <= 1


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert sp.shared_spans(e).count() == 0 and sp.shared_portion(sp.shared_extents(e), e).count() == 0


def test_long_copies_come_out_whole(spark):
    """A shared stretch has its true start and length, however long; pieces of other alignments stay apart."""
    r = random.Random(4)
    x, y, z, u, v = ("".join(r.choices("abcdefghij klmnop", k=n)) for n in (5000, 900, 450, 300, 70))
    texts = [(1, x), (2, x), (3, u + x[100:4100] + "#" + v), (4, y + z), (5, z + v + y)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(q) for q in sp.merge_spans(sp.shared_spans(df)).collect()}
    assert got == {(1, 2, 0, 0, 5000), (1, 3, 100, 300, 4000), (2, 3, 100, 300, 4000), (4, 5, 0, 520, 900), (4, 5, 900, 0, 450)}


def test_short_run_at_another_phase_meets_the_inside_of_a_long_run(spark):
    """Only an alignment with an inner repetition of the long run reaches the asked length."""
    texts = []
    for seed in range(60):
        r = random.Random(seed)
        n = r.choice([120, 150, 158])
        line = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        at = r.randrange(n)
        texts += [(2 * seed, "#" + (line * 20)[r.randrange(n) : 2000] + "!"), (2 * seed + 1, "<" + (line * 6)[at : at + 400 + r.randrange(20)] + ">")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(q.doc_a, q.doc_b) for q in sp.span_pairs(sp.shared_spans(df)).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(60)}


def _covered(rows):
    out = {}
    for d, s, e in rows:
        out.setdefault(d, set()).update(range(s, e))
    return out


@pytest.mark.parametrize(("block", "few"), [(3, 64), (2000, 64), (3, 0), (2000, 0)])
def test_extents_cover_what_the_pairs_cover(spark, monkeypatch, block, few):
    """In cells and whole groups, by comparing and by sorting: headers shared by many, copies within one document, and stretches next to each other."""
    monkeypatch.setattr(sp, "BLOCK", block)
    monkeypatch.setattr(sp, "FEW", few)
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    head, other = word(90), word(70)
    docs = [(i, word(rnd.randrange(40)) + head[: rnd.choice([60, 75, 90])] + word(30) + (other if i % 3 == 0 else "") + (head if i == 5 else "")) for i in range(14)] + [(50, word(100) * 3), (51, None), (52, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = sp.shared_spans(df, min_chars=60, k=40).collect()
    want = _covered([(r.doc_a, r.start_a, r.start_a + r.length) for r in pairs] + [(r.doc_b, r.start_b, r.start_b + r.length) for r in pairs])
    got = _covered([(r.doc, r.s, r.e) for r in sp.shared_extents(df, min_chars=60, k=40).collect()])
    assert got == want and len(want) >= 10
    text = dict(docs)
    brute = {(i, j) for i, a in docs for j, b in docs if i < j and a and b and any(a[x : x + 60] in b for x in range(len(a) - 59))}
    assert {(r.doc_a, r.doc_b) for r in pairs} == brute and all(text[r.doc_a][r.start_a : r.start_a + r.length] == text[r.doc_b][r.start_b : r.start_b + r.length] for r in pairs)


def test_many_surroundings_take_no_long():
    import time

    rnd = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, rnd.integers(97, 101, n)))
    left, right = word(160), word(160)
    rows = [("k", 0, 0, 0, i, 5000, word(160 - (i % 160)) + left[160 - (i % 160) :], right[: 160 - (i * 7) % 160] + word((i * 7) % 160)) for i in range(2000)]
    t = time.process_time()
    by_sorting = sp._Group(list(rows), 400, 240).extents()
    assert time.process_time() - t < 10
    sp_few = sp.FEW
    try:
        sp.FEW = 10**9
        compared = sp._Group(list(rows[:300]), 400, 240).extents()
        sp.FEW = 0
        sorted_ = sp._Group(list(rows[:300]), 400, 240).extents()
    finally:
        sp.FEW = sp_few
    flat = lambda res: sorted((int(d), int(a), int(b)) for x in res for d, a, b in zip(*x, strict=True))
    assert by_sorting and flat(compared) == flat(sorted_) and len(flat(sorted_)) > 100
