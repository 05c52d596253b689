"""Definitions and edges by structure, language by language."""

from __future__ import annotations

import time

import pytest

from loomgrid.operators import structure as st

CASES = {
    "rs": (
        'use a::{b, c::{self, D}};\npub mod inner;\n// fn not_me() {}\npub struct Unit;\nstruct Pair { x: u8 }\nenum E { A }\ntrait Walk { fn step(&self); }\nimpl<T> Walk for Pair<T> {\n    fn step(&self) { helper("fn no() {"); }\n}\nconst MAX: u8 = 1;\ntype Short = Vec<u8>;\npub fn run(x: &str) -> u8 {\n    let y = seal(x);\n    m::walk(y)\n}\n',
        {("inner", "module"), ("Unit", "struct"), ("Pair", "struct"), ("E", "enum"), ("Walk", "trait"), ("step", "function"), ("MAX", "constant"), ("Short", "type_alias"), ("run", "function")},
        {("run", "seal"), ("run", "m::walk"), ("step", "helper")},
        {("", "IMPORTS", "a::b"), ("", "IMPORTS", "a::c"), ("", "IMPORTS", "a::c::D"), ("Pair", "IMPLEMENTS", "Walk")},
    ),
    "go": (
        'package p\nimport (\n\t"fmt"\n\tx "net/http"\n)\nimport "os"\nconst (\n\tA = 1\n\tB\n)\nvar top = 3\ntype Store struct { n int }\ntype Walker interface { Walk() }\ntype Short = string\nfunc (s *Store) Open(k string) error {\n\treturn check(k)\n}\nfunc main2() {\n\tseal(`func no() {`)\n}\n',
        {("A", "constant"), ("B", "constant"), ("top", "constant"), ("Store", "struct"), ("Walker", "interface"), ("Short", "type_alias"), ("Open", "method"), ("main2", "function")},
        {("Open", "check"), ("main2", "seal")},
        {("", "IMPORTS", "fmt"), ("", "IMPORTS", "net/http"), ("", "IMPORTS", "os")},
    ),
    "ts": (
        'import { a } from "./a";\nconst fs = require(\'fs\');\nexport interface Shape extends Base { n: number }\nexport type Short = string;\nexport class Box<T> extends Shape2 implements A, B<T> {\n  private x = 1;\n  open(k: string): void { seal(k); }\n  static async make() { return build(); }\n}\nexport function run(x: number): number { if (x) { walk(x); } return 1; }\nconst go = async (a: string) => { go2(a); };\nconst one = (a) => a + 1;\nexport const LIMIT = 3;\n',
        {("Shape", "interface"), ("Short", "type_alias"), ("Box", "class"), ("open", "method"), ("make", "method"), ("run", "function"), ("go", "function"), ("one", "function"), ("LIMIT", "constant"), ("fs", "constant")},
        {("open", "seal"), ("make", "build"), ("run", "walk"), ("go", "go2")},
        {("", "IMPORTS", "./a"), ("", "IMPORTS", "fs"), ("Shape", "INHERITS", "Base"), ("Box", "INHERITS", "Shape2"), ("Box", "IMPLEMENTS", "A"), ("Box", "IMPLEMENTS", "B")},
    ),
    "java": (
        'package p;\nimport java.util.List;\nimport static a.B.c;\n@X\npublic class Box<T> extends Base implements A, B<T> {\n  private final int n = 1;\n  /* void no() {} */\n  public Box(int n) { this.n = n; }\n  @Override\n  public List<T> open(String k) throws Oops { return seal(k); }\n}\ninterface Shape extends S2 { void draw(int x); }\nenum Color { RED }\n',
        {("Box", "class"), ("n", "variable"), ("Box", "method"), ("open", "method"), ("Shape", "interface"), ("draw", "method"), ("Color", "enum")},
        {("open", "seal")},
        {("", "IMPORTS", "java.util.List"), ("", "IMPORTS", "a.B.c"), ("Box", "INHERITS", "Base"), ("Box", "IMPLEMENTS", "A"), ("Box", "IMPLEMENTS", "B"), ("Shape", "INHERITS", "S2")},
    ),
    "c": (
        '#include <stdio.h>\n#include "own.h"\n#define MAX(a) { a }\ntypedef unsigned int u32;\nstruct Node { int n; };\nenum Color { RED };\nstatic int walk(struct Node *n, int (*f)(int)) {\n  if (n) { seal(n); }\n  return 1;\n}\nint declared(int);\n',
        {("u32", "type_alias"), ("Node", "struct"), ("Color", "enum"), ("walk", "function")},
        {("walk", "seal")},
        {("", "IMPORTS", "stdio.h"), ("", "IMPORTS", "own.h")},
    ),
    "cpp": (
        '#include <vector>\nnamespace a::b {\nclass Box : public Base, private Other<int> {\n public:\n  Box(int n) : n_(n) { init(); }\n  int open() const { return seal(n_); }\n};\nstruct P { int x; };\nenum class Color { RED };\nusing Short = int;\nint Box::go(int x) { return walk(x); }\n}\n',
        {("a::b", "module"), ("Box", "class"), ("Box", "method"), ("open", "method"), ("P", "struct"), ("Color", "enum"), ("Short", "type_alias"), ("go", "function")},
        {("open", "seal"), ("go", "walk"), ("Box", "init")},
        {("", "IMPORTS", "vector"), ("Box", "INHERITS", "Base"), ("Box", "INHERITS", "Other")},
    ),
    "cs": (
        'using System.Text;\nnamespace A.B {\npublic class Box<T> : Base, IShape<T> where T : new() {\n  private readonly int n = 1;\n  public int Size { get; set; }\n  public Box(int n) : base(n) { Init(n); }\n  public int Open(string k) { return Seal(k); }\n}\ninterface IShape { void Draw(int x); }\nenum Color { Red }\nstruct P { public int X; }\n}\n',
        {("A.B", "module"), ("Box", "class"), ("n", "variable"), ("Size", "variable"), ("Box", "method"), ("Open", "method"), ("IShape", "interface"), ("Draw", "method"), ("Color", "enum"), ("P", "struct"), ("X", "variable")},
        {("Open", "Seal"), ("Box", "Init")},
        {("", "IMPORTS", "System.Text"), ("Box", "INHERITS", "Base"), ("Box", "IMPLEMENTS", "IShape")},
    ),
    "php": (
        "<?php\nnamespace A\\B;\nuse C\\D;\n# function no() {}\ninterface Shape extends S2 { public function draw(); }\nclass Box extends Base implements A, Shape {\n  public function open($k) { return seal($k); }\n}\nfunction run() { walk('function x() {'); }\n",
        {("A\\B", "module"), ("Shape", "interface"), ("draw", "method"), ("Box", "class"), ("open", "method"), ("run", "function")},
        {("open", "seal"), ("run", "walk")},
        {("", "IMPORTS", "C\\D"), ("Shape", "INHERITS", "S2"), ("Box", "INHERITS", "Base"), ("Box", "IMPLEMENTS", "A"), ("Box", "IMPLEMENTS", "Shape")},
    ),
    "scala": (
        "import a.b.C\ntrait Shape extends S2 { def draw(): Unit }\nclass Box(n: Int) extends Base with Shape {\n  def open(k: String): Int = {\n    seal(k)\n  }\n}\nobject Box {\n  def make(): Box = { build() }\n}\n",
        {("Shape", "trait"), ("Box", "class"), ("open", "function"), ("Box", "module"), ("make", "function")},
        {("open", "seal"), ("make", "build")},
        {("", "IMPORTS", "a.b.C"), ("Shape", "INHERITS", "S2"), ("Box", "INHERITS", "Base"), ("Box", "INHERITS", "Shape")},
    ),
    "rb": (
        "require 'json'\nmodule A\n  class Box < Base\n    # def no; end\n    def open(k)\n      if k\n        seal(k)\n      end\n      walk(k)\n    end\n    def self.make!\n      build(1)\n    end\n  end\nend\ndef free\n  go(1)\nend\n",
        {("A", "module"), ("Box", "class"), ("open", "method"), ("make!", "method"), ("free", "function")},
        {("open", "seal"), ("open", "walk"), ("make!", "build"), ("free", "go")},
        {("", "IMPORTS", "json"), ("Box", "INHERITS", "Base")},
    ),
    "py": (
        "import os\nfrom a.b import c\nclass Box(Base):\n    def open(self, k):\n        return seal(k)\ndef run():\n    walk('def no():')\n",
        {("Box", "class"), ("open", "method"), ("run", "function")},
        {("open", "seal"), ("run", "walk")},
        {("", "IMPORTS", "os"), ("", "IMPORTS", "a.b"), ("Box", "INHERITS", "Base")},
    ),
}


@pytest.mark.parametrize("lang", list(CASES))
def test_structure(lang):
    text, want, calls, edges = CASES[lang]
    s, c, e = st.scan(text, lang)
    assert {(n, k) for n, k, *_ in s} == want
    assert {(a, b) for a, b, _ in c} == calls
    assert {x[:3] for x in e} == edges
    for n, _, line, sig in s:
        assert n.split("::")[-1] in text.split("\n")[line - 1] and sig


def test_svelte_scripts_keep_their_lines():
    text = "<h1>function no() {}</h1>\n<script lang='ts'>\n  export function go() { seal(1); }\n</script>\n<p>{x}</p>\n"
    s, c, _ = st.scan(text, "svelte")
    assert [(n, k, line) for n, k, line, _ in s] == [("go", "function", 3)] and c == [("go", "seal", 3)]


@pytest.mark.parametrize("text", [None, "", "{", "}", "}}}{{{(((", "fn", '"', "/*", "'", "r#\"", "fn a() { \"" + "x" * 50])
def test_broken_texts(text):
    for lang in [*st.LANGUAGES, "py", "md", None]:
        assert len(st.scan(text, lang)) == 3


@pytest.mark.parametrize("line", ["fn a(x: u8) { b(x); }\n", "(((", "{", "\"", "a b c ", "class A extends ", "x = [1, 2];\n", "/* ", "type T<", "f(g(h(1)));\n"])
def test_long_texts_take_no_long(line):
    for lang in ("rs", "ts", "java", "cpp", "cs", "scala"):
        t = time.process_time()
        st.scan(line * (40_000 // len(line)), lang)
        assert time.process_time() - t < 5


def test_tables(spark, rows):
    df = spark.createDataFrame([(f"f.{k}", k, v[0], "x") for k, v in CASES.items()] + [("n", "rs", None, "x"), ("m", "md", "# a", "x")], "file string, language string, content string, name string")
    got = st.symbols(df)
    assert {(r.file, r.name, r.kind) for r in got.collect()} == {(f"f.{k}", *x) for k, v in CASES.items() for x in v[1]}
    e = st.edges(df)
    assert e.where("kind = 'CALLS'").count() == sum(len(v[2]) for v in CASES.values()) and st.edges(df.where("false")).count() == 0
