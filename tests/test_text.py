"""Tokens, search, extraction, replies, context and sources."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import paths as p
from loomgrid.functions import text as t
from loomgrid.operators import context, extract, replies, search
from loomgrid.sources import config, files


@pytest.mark.parametrize(("name", "words"), [("XMLParser", ["XML", "Parser"]), ("parseHTML", ["parse", "HTML"]), ("a", ["a"]), ("snake_case", ["snake_case"]), ("", []), ("fooBarBaz", ["foo", "Bar", "Baz"])])
def test_camel_words(name, words):
    assert t.camel_words(name) == words


@pytest.mark.parametrize(("text", "query"), [("main", '"main"'), ("a b", '"a" "b"'), ("fn(x)!", '"fnx"'), ("", ""), ("fooBar", '"fooBar" OR "foo" OR "Bar"'), ("HTTP", '"HTTP"')])
def test_fts_query(text, query):
    assert t.fts_query(text) == query


def test_code_tokens():
    n = t.code_tokens("fooBar foo_bar HTTPServer x = 12; y == 123456 1.5 (a)")
    assert n["foo"] == 2 and n["bar"] == 2 and n["http"] == 1 and n["server"] == 1
    assert n["12"] == 1 and n["<NUM>"] == 1 and n["<FLOAT>"] == 1 and n["=="] == 1 and n["="] == 1
    assert "x" not in n and "(" not in n and ";" not in n
    assert t.code_tokens(None) == t.code_tokens("") == {}
    assert len(t.code_tokens(" ".join(f"w{i}a" for i in range(900)))) == t.MAX_TOKENS


def test_embedding_has_unit_length_and_is_stable(spark):
    v = t.embed(t.code_tokens("fn seal(x: u32)"))
    assert v.shape == (256,) and math.isclose((v * v).sum(), 1) and (v >= 0).all()
    assert (v == t.embed(t.code_tokens("fn seal(x: u32)"))).all() and not t.embed({}).any()
    h = 0xC07AC0DEC0DEC0DE
    for b in b"fn":
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    assert t.token_vector("fn")[0] == (h >> 33) / (2**31 - 1)
    got = spark.createDataFrame([("fn seal(x: u32)",)], "s string").select(t.embed_udf("s")).first()[0]
    assert np.allclose(got, v, atol=1e-6)


def test_bm25_against_brute_force(spark):
    docs = [(1, "alpha beta beta"), (2, "alpha"), (3, None), (4, ""), (5, "gamma alpha beta delta"), (6, "beta_x")]
    df = spark.createDataFrame(docs, "id long, body string")
    got = {r.doc: r.score for r in search.bm25(df, "beta", "id", ["body"]).collect()}
    words = {i: [w for w in (b or "").replace("_", " ").split()] for i, b in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    d = sum("beta" in w for w in words.values())
    idf = max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6)
    for i, w in words.items():
        tf = w.count("beta")
        if tf:
            assert math.isclose(got[i], idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)))
        else:
            assert i not in got
    assert search.bm25(df, "  ", "id", ["body"]).count() == 0
    assert {r.doc for r in search.bm25(df, "alphaBeta", "id", ["body"]).collect()} == {1, 2, 5, 6}


def test_search_falls_back_to_names(spark, rows):
    s = spark.createDataFrame([(1, "sealBox", "function", "a.rs", 1, "fn sealBox()", "rust", 1), (2, "open", "method", "c.rs", 1, "", "rust", 1)], "id long, name string, kind string, file string, line int, signature string, language string, project_id long")
    assert rows(search.search(s, "sealBox"), "id") == [(1,)]
    assert rows(search.search(s, "ealB"), "id", "score") == [(1, 1.0)]
    assert rows(search.search(s, None, kind="method"), "id", "score") == [(2, 0.0)]
    assert search.search(s, "ealB", kind="method").count() == 0


def test_knn_and_fusion(spark, rows):
    v = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(3)]) for i in range(3)] + [(7, [1.0]), (8, [0.0, 0.0, 0.0])], "id long, vec array<float>")
    assert [r.id for r in search.knn(v, [0.9, 0.1, 0.0], 2).collect()] == [0, 1]
    assert search.knn(v, [0.0, 0.0, 0.0], 2).count() == 0
    assert rows(search.knn(v, [1.0, 0.0, 0.0], 9, members=spark.createDataFrame([(1,), (2,)], "id long")), "id") == [(1,), (2,)]
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    f = search.fuse({"a": a, "b": b}).collect()
    assert [r.id for r in f] == [2, 1, 3] and f[0].signals == ["a", "b"] and math.isclose(f[0].score, 1 / 61 + 1 / 62)
    assert [r.id for r in search.fuse({"b": b, "a": a}).collect()] == [2, 1, 3]
    new = spark.createDataFrame([(1, [9.0, 0.0, 0.0]), (1, [5.0, 0.0, 0.0])], "id long, vec array<float>")
    assert rows(search.upsert_vectors(v, new).where("id = 1"), "vec") == [([9.0, 0.0, 0.0],)]
    assert search.remove_vectors(v, new).count() == 4


def test_paths(spark, rows):
    names = ["src/a.RS", "Makefile", "dockerfile", "x/latest/a_test.py", "docs/a.md", "org", "aspect.ts", "w\\b.c"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = {r[0]: tuple(r[1:]) for r in df.select("f", p.language("f"), p.is_test("f"), p.is_doc("f"), p.family("f"), p.directory("f")).collect()}
    assert got["src/a.RS"] == ("rs", False, False, "rust", "src") and got["Makefile"][0] == "unknown" and got["dockerfile"][0] == "dockerfile"
    assert got["x/latest/a_test.py"][1] and not got["aspect.ts"][1] and got["docs/a.md"][2] and not got["org"][2] and got["w\\b.c"][4] == "w"
    hit = lambda rx, s: spark.createDataFrame([(s,)], "s string").select(F.col("s").rlike(rx)).first()[0]
    assert hit(p.exclude_regex("tests/"), "a/tests/b.rs") and not hit(p.exclude_regex("tests/"), "mytests/b.rs")
    assert hit(p.exclude_regex("*_test.*"), "a/b_test.go") and hit(p.exclude_regex("gen/**"), "gen/x/y") and hit(p.exclude_regex("*mock*"), "a/mocker.rs")
    assert hit(p.skip_regex("**/*.lock"), "a/b.lock") and hit(p.skip_regex("**/dist/**"), "a/dist/b") and hit(p.skip_regex("Cargo.*"), "x/Cargo.toml") and not hit(p.skip_regex("dist/**"), "distance/a")


SNIPPETS = [
    ("rs", "pub fn seal(x: u32) {}\nstruct Box;\nenum E {}\ntrait T {}\nconst N: u8 = 1;", {("seal", "function"), ("Box", "struct"), ("E", "enum"), ("T", "trait"), ("N", "constant")}),
    ("py", "class A:\n    async def run(self):\n        pass", {("A", "class"), ("run", "function")}),
    ("tsx", "export class V {}\ninterface I {}\nexport const q = 1", {("V", "class"), ("I", "interface"), ("q", "constant")}),
    ("go", "func (s *S) Do() {}\ntype S struct {}\ntype R interface {}", {("Do", "function"), ("S", "struct"), ("R", "interface")}),
    ("rb", "class A\n  def self.b\n  end\nend", {("A", "class"), ("b", "function")}),
    ("php", "final class K {}\npublic static function f() {}", {("K", "class"), ("f", "function")}),
    ("swift", "public func go() {}\nprotocol P {}", {("go", "function"), ("P", "class")}),
    ("lua", "local function a.b()\nend", {("b", "function")}),
    ("zig", "pub fn z() void {}", {("z", "function")}),
    ("dart", "mixin M {}\nvoid f() {}", {("M", "class"), ("f", "function")}),
    ("unknown", "fn x() {}", set()),
]


@pytest.mark.parametrize(("lang", "code", "want"), SNIPPETS)
def test_symbols(spark, lang, code, want):
    df = spark.createDataFrame([("f", lang, code), ("g", lang, ""), ("h", lang, None)], "file string, language string, content string")
    assert {(r.name, r.kind) for r in extract.symbols(df).collect()} == want


def test_svelte_component(spark):
    df = spark.createDataFrame([("ui/side-bar_item.svelte", "svelte", "<script>\n  export let open;\n  let n = $state(0);\n  $effect(() => {});\n  function go() {}\n</script>")], "file string, language string, content string")
    assert {(r.name, r.kind, r.line) for r in extract.symbols(df).collect()} == {("SideBarItem", "struct", 1), ("open", "variable", 2), ("n", "variable", 3), ("$effect", "function", 4), ("go", "function", 5)}


def test_edges_and_routes(spark, rows):
    rs = 'use crate::a::b;\nfn outer() {\n  helper(1);\n  outer();\n  vec(2);\n}\nfn r() { app.route("/x", get(h::show)) }'
    py = "import os\nclass A(B):\n    def m(self):\n        self.go()\n@app.route('/p')\ndef v():\n    helper()"
    df = spark.createDataFrame([("a.rs", "rs", rs), ("b.py", "py", py), ("c.py", "py", "def ("), ("d.rs", "rs", None)], "file string, language string, content string")
    got = set(rows(extract.edges(df), "source", "kind", "target"))
    assert {("outer", "CALLS", "helper"), ("", "IMPORTS", "crate::a::b"), ("show", "ROUTE", "GET /x"), ("A", "INHERITS", "B"), ("m", "CALLS", "self.go"), ("v", "CALLS", "helper"), ("", "IMPORTS", "os")} <= got
    assert ("outer", "CALLS", "outer") not in got and ("outer", "CALLS", "vec") not in got
    assert ("route_line_5", "ROUTE", "/p") in got


def test_candidates():
    assert "tests/test_a.py" in extract.test_candidates("src/a.py") and extract.test_candidates("x") == []
    assert extract.import_candidates("crate::m::T", "rs")[-1] == "src/m/mod.rs"
    assert extract.definition_extent("fn a() {\n  b();\n}\nfn c() {}", 1) == (1, 3)
    assert extract.definition_extent("def a():\n    b\n    c\nd", 1) == (1, 3)


REPLIES = [
    ('[{"file": "a", "title": "t", "severity": "Major", "line": null, "type": "bug"}]', 1, ""),
    ('```json\n[{"file": "a", "title": "t"}]\n```', 1, ""),
    ('[{"file": "a", "title": "t"}]\n|||fine work|||', 1, "fine work"),
    ("[]", 0, ""),
    ('[{"file": "a", "title": "t"}, {"file": "b", "ti', 1, ""),
    ('[{"file": "a", "title": "C:\\path"}]', 1, ""),
    ('{"issues": [{"file": "a", "title": "t"}], "summary": "s"}', 1, "s"),
]


@pytest.mark.parametrize(("raw", "n", "summary"), REPLIES)
def test_replies(raw, n, summary):
    got, s, error = replies.parse_reply(raw)
    assert (len(got), s, error) == (n, summary, None)


def test_bad_replies(spark):
    assert replies.parse_reply("Rate limited")[2].startswith("no JSON") and replies.parse_reply(None)[2] == "empty reply"
    assert replies.parse_reply(REPLIES[0][0])[0][0] == {"file": "a", "line": None, "severity": "major", "issue_type": "bug", "title": "t", "body": "", "suggested_fix": None}
    df = spark.createDataFrame([(1, REPLIES[0][0]), (2, "x"), (3, None)], "reply_id long, text string")
    assert {(r.reply_id, r.title) for r in replies.parse_replies(df).collect()} == {(1, "t"), (2, None), (3, None)}


def test_context_budget(spark, rows):
    e = spark.createDataFrame([(1, 1, "caller", "x" * 40), (1, 2, "function", "y" * 400), (1, 3, "function", "fn a() {\n" + "z" * 4000), (1, 4, "type", ""), (2, 1, "test", None)], "review int, seq int, kind string, content string")
    got = rows(context.assemble(e, 110), "review", "seq", "used", "budget_hit")
    assert got == [(1, 2, 100, True), (1, 3, 2, True)]
    o = spark.createDataFrame([("r", "n", "function", "f", 1, 10), ("r", "m", "function", "f", 5, 9), ("r", "k", "function", "f", 11, 12)], "ref_file string, name string, kind string, file string, line_from int, line_to int")
    assert {r[0] for r in rows(context.drop_overlaps(o), "name")} == {"n", "k"}
    assert context.tokens("") == 0 and context.tokens("ab") == 1


def test_tree_sources(spark, rows, tmp_path):
    for name, text in {"a.py": "x = 1\n", "b.bin": "q", ".hidden/c.py": "y", "blank.py": "  \n", "sub/d.rs": "fn d() {}\nfn e() {}", "LICENSE": "free", "target/e.rs": "z"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00")
    got = rows(files.walk_project(spark, str(tmp_path), files.ignore_regexes("# note\n/target/\n")), "path", "language")
    assert got == [("a.py", "py"), ("blank.py", "py"), ("sub/d.rs", "rs")]
    assert rows(files.walk_scan(spark, str(tmp_path), exclude=["target/**"]), "path", "lines") == [("LICENSE", 1), ("a.py", 1), ("sub/d.rs", 2)]
    (tmp_path / "Cargo.toml").write_text("")
    assert files.project_root(str(tmp_path / "sub")) == str(tmp_path)


def test_refs_vocabulary_and_settings(spark):
    assert files.valid_ref("main") and files.valid_ref("v1.2-x") and not files.valid_ref("") and not files.valid_ref("-x") and not files.valid_ref("a;b") and not files.valid_ref("a..b")
    ix, vec = files.read_vocabulary(struct.pack("<II", 2, 2) + struct.pack("4b", 127, 0, 0, 127), ["Foo", "foo"])
    assert ix == {"foo": 0} and vec == [[1.0, 0.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        files.read_vocabulary(struct.pack("<II", 2, 2), [])
    tok = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "zz", 1)], "id long, token string, n int")
    voc = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vec array<double>")
    assert np.allclose(files.pretrained_embeddings(tok, voc).first().vec, [0.6, 0.8])
    assert config.merge({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}, {"a": {"x": None}}) == {"a": {"x": 1, "y": 3}}
    assert config.gate({"categories": {"Security": {"action": "BLOCK", "max_findings": 1}}}).categories == {"security": ("block", 1)}
    for bad in ({"maximum": 1}, {"categories": {"x": {"action": "blok"}}}):
        with pytest.raises(ValueError):
            config.gate(bad)
    pr = {"a": config.Profile("a", None, {"x": (3, "one")}), "b": config.Profile("b", "a", {"y": (9, "two")}), "c": config.Profile("c", "c")}
    assert config.profile_prompt(config.resolve_profile("b", pr)) == "- y (9/10): two\n- x (3/10): one"
    with pytest.raises(ValueError):
        config.resolve_profile("c", pr)
    assert config.backend("auto", False) == "hashing" and config.backend(None, True) == "pretrained"


def test_the_last_write_of_a_vector_wins(spark, rows):
    old = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vec array<float>")
    new = spark.createDataFrame([(1, [9.0], 1), (1, [5.0], 2), (3, [3.0], None), (3, [1.0], 0)], "id long, vec array<float>, seq int")
    assert rows(search.upsert_vectors(old, new, order="seq"), "id", "vec") == [(1, [5.0]), (2, [2.0]), (3, [1.0])]


def test_lines_of_a_diff_end_at_newlines_only():
    from loomgrid.operators import diff

    text = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-s = 'p'\r\n+s = 'p\u2028q\x0cr\x85'\n t\n"
    lines = diff.parse(text)[0]["hunks"][0]["lines"]
    assert [x[:2] for x in lines] == [("remove", "s = 'p'"), ("add", "s = 'p\u2028q\x0cr\x85'"), ("context", "t")] and diff.parse(None) == diff.parse("") == []


def test_chunks_can_be_parsed_again(spark):
    from loomgrid.operators import diff

    one = lambda f, n: f"--- a/{f}\n+++ b/{f}\n@@ -1,0 +1,{n} @@\n" + "+b\n" * n
    text = one("src/x.py", 2) + one("src/y.py", 1) + one("lib/z.py", 300)
    for size in (10, 200, 100_000):
        parts = diff.chunk(text, size)
        again = [f for *_, t in parts for f in diff.parse(t)]
        assert again == diff.parse(text) and sum(n for _, _, _, n, _ in parts) == 3
    assert [(a, b, c, d) for a, b, c, d, _ in diff.chunk(text, 200)] == [(0, 2, "src/*", 2), (1, 2, "lib/*", 1)]
    assert diff.chunk("no diff", 5) == [(0, 1, "empty", 0, "no diff")] and diff.chunk(None, 5) == [(0, 1, "empty", 0, "")]
