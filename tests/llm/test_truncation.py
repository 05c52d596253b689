"""Cut-off texts: endings, near-copies and closing words."""

from __future__ import annotations

import pytest

from loomgrid.llm import truncation as t

CUT = ["It was slow. The lock was he…", "It was slow. Then it [truncated]", "Done. Now the (truncated)", "One thing. Two things and then the par", "Text.\n```\ndef f():\n    x = 1", "pub fn a() {\n    if x {\n        b();\n    }", 'x = f("abc', "See `fetch_pa", "It is in one. The default in app/views/rotate_palette_coo", "def f(x):", "+    if let Some(x) = foo(ba"]
WHOLE = ["", "  ", "All is well.", "Done. See also src/core/a_b.rs", "Is it?", "Text.\n\n```\nx = 1\n```", "pub fn a() {\n    b();\n}", "-    if a {\n+    if b {", "- buildSha = \"x\"\n+ let y = f(1)?;", "Fine work.\n\nRefs: DOCS-12", "x = [1, 2]", "// don't do it (or else)", "max_tokens = 12", "Its output ends with `[truncated]` here."]


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert t.judge(text)[0] == "cut"


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert t.judge(text)[0] != "cut"


def values(spark, texts):
    df = spark.createDataFrame([(i, x, "p", "a", "b") for i, x in enumerate(texts)], "id long, body string, provider string, text string, field string")
    return t.text_values(df, "tab", "id", ["body"], "provider")


LONG = "- read the setting once before the loop starts\n- use the bounded queue when the branch was force pushed and then go on with the very next item of the list as before"


def test_near_copies_and_closing_words(spark):
    lists = [f"- do thing {i} with the lock\n- close handle {i} after the failed deploy" for i in range(8)]
    texts = [*lists, "- do thing 3 with the lock\n- close handle 3 after the", LONG, LONG[:-7], None, "", LONG]
    got = {r.row_id: r.reason for r in t.cut_values(values(spark, texts)).collect()}
    assert set(got) == {8, 10} and got[10] in ("copy_goes_on", "closing_word")


def test_ends_early():
    a = " ".join(f"word{i}" for i in range(40))
    assert t.ends_early(a[:-3], a + " and more") and not t.ends_early(a, a) and not t.ends_early(a + ".", a + ". More.")
    assert not t.ends_early(a, a + "\nnext line") and not t.ends_early("some other text without any relation", a)


def test_rates_and_repeats(spark):
    v = values(spark, ["Good.", "Bad and. Then it …"])
    v = v.unionByName(v)
    c = t.cut_values(v)
    assert [(r.provider, r.n_values, r.n_cut) for r in t.cut_rates(v, c).collect()] == [("p", 2, 1)]


def test_empty_and_long(spark):
    assert t.cut_values(values(spark, [])).count() == 0
    long = "A sentence of words. " * 20_000
    assert {r.row_id for r in t.cut_values(values(spark, [long, long + "And then the"])).collect()} == {1}


def test_bands_find_copies():
    a = " ".join(f"w{i}" for i in range(100))
    x, y, z = t.bands([a, a + " tail", "too short"]).to_pylist()
    assert len(x) == t.BANDS and set(x) & set(y) and z == []


@pytest.mark.parametrize("text", ["(" * 50_000 + ")" * 50_000, "x = " + "1a" * 60_000 + "!", '"' + "\\" * 50_001, "a " * 50_000, "a/" * 50_000, "`" * 40_001, "x: " + "1" * 100_000 + "("])
def test_no_text_takes_long(text):
    import time

    s = time.perf_counter()
    t.judge(text)
    t.closings(text, {})
    assert time.perf_counter() - s < 10


def _noise(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return "- " + " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize("share", [0.05, 0.15, 0.3, 0.5, 0.9])
def test_copies_cut_anywhere_meet_their_source(spark, share):
    full = [_noise(i, 120) for i in range(20)]
    cut = [x[: int(len(x) * share)] for x in full]
    cut = [x[:-1] if x[-1] == " " else x for x in cut]
    asks = [(i, x) for i, x in enumerate(cut) if t.judge(x)[0] == "ask"]
    got = {r.row_id: r.reason for r in t.cut_values(values(spark, cut + full)).collect()}
    assert asks and {i for i, _ in asks} <= set(got)
    assert all(i < len(cut) for i, r in got.items() if r == "copy_goes_on")


def test_every_longer_member_of_a_template_is_aligned(spark):
    """The longest text of the template is another variant; the true source is one of the shorter ones."""
    head = _noise(1, 60)
    full = [f"{head} {_noise(100 + i, 10)[2:]}" for i in range(30)]
    longest = f"{head} {_noise(999, 60)[2:]}"
    cut = [x[:-4] for x in full]
    asks = {i for i, x in enumerate(cut) if t.judge(x)[0] == "ask"}
    got = {r.row_id for r in t.cut_values(values(spark, [*cut, *full, longest])).collect()}
    assert len(asks) > 20 and asks <= got


def test_cells_and_exact_alignment(spark, monkeypatch):
    """Groups cut in cells find what comparing all pairs finds."""
    monkeypatch.setattr(t, "CELL", 3)
    texts = []
    for i in range(12):
        w = _noise(7, 60).split(" ")
        w[10 + i] = f"other{i}"
        texts += [" ".join(w), " ".join(w)[: 260 + (i % 3)], _noise(50 + i, 20)]
    ask = {i for i, x in enumerate(texts) if t.judge(x)[0] == "ask"}
    want = {i for i in ask if any(t.ends_early(texts[i], y) for y in texts)}
    asks = spark.createDataFrame([(i, t.tail_keys(texts[i]), texts[i]) for i in ask], "th long, tails array<long>, text string")
    got = {r.th for r in t.near_copies(asks, spark.createDataFrame([(x,) for x in texts], "text string"), t.Workspace(spark, "test")).collect()}
    assert want and want == got


def test_whole_without_a_hard_closing_mark_is_aligned(spark):
    """A list item cut after a comma is whole by its end alone; its longer copy shows the cut."""
    full = "- keep the queue bounded when the remote worker is slow, then drop the oldest entry"
    cut = full[: full.index(",") + 1]
    assert t.judge(cut)[0] == "whole"
    stop = "Keep the queue bounded when the remote worker is slow."
    got = {r.row_id for r in t.cut_values(values(spark, [cut, full, stop, stop + " Then drop the oldest."])).collect() if r.reason == "copy_goes_on"}
    assert got == {0}


def test_fragment_met_often_and_delivered_again_stays_cut(spark):
    """A piece of a word stays one however often it is met or its text is delivered."""
    known = [f"- see job {i}a before you handle it" for i in range(20)]
    cut = [f"- the worker {chr(97 + i)}x must go on with the handl" for i in range(4)]
    for texts in (known + cut, known + cut[:1] * 12, (known + cut) * 3):
        got = {r.row_id for r in t.cut_values(values(spark, texts)).collect()}
        assert got == {i for i, x in enumerate(texts) if x in cut}


def test_a_template_of_many_copies_is_met_in_cells(spark, monkeypatch):
    """Many values of one template, cut at one place, and as many sources: each value finds its own or a near source."""
    monkeypatch.setattr(t, "CELL", 4)
    body = _noise(3, 40)
    full = [f"{body} and item {i} goes on with the very same words as all the others do here" for i in range(40)]
    cut = [x[:-9] for x in full]
    other = [_noise(200 + i, 40) for i in range(10)]
    asks = spark.createDataFrame([(i, t.tail_keys(x), x) for i, x in enumerate(cut + [x[:-1] + "q" for x in other])], "th long, tails array<long>, text string")
    got = {r.th for r in t.near_copies(asks, spark.createDataFrame([(x,) for x in full + other], "text string"), t.Workspace(spark, "test")).collect()}
    assert got == set(range(40))
