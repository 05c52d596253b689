"""Definitions, calls and typed edges by the structure of a source text.

Comments and literals are blanked first, so nothing inside them counts.  What is
left is cut at braces and semicolons; the text before an opening brace is a head
that says what the braces hold, and the open braces are the scopes a definition or
a call stands in.  Ruby has no braces; there the indent of a head closes its scope.
Python goes by its own grammar.  One text is scanned at a time, in one pass.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from loomgrid.operators.extract import BUILTINS, python_graph

_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_DOUBLE, _SINGLE, _CHAR = r'"(?:\\.|[^"\\\n])*+"?', r"'(?:\\.|[^'\\\n])*+'?", r"'(?:\\[^'\n]+|[^'\\\n])'"
_TEMPLATE, _RAW, _TRIPLE = r"`(?:\\.|[^`\\])*+`?", r"`[^`]*+`?", r'"""(?:[^"]|"(?!""))*+(?:""")?'
_MASKS = {
    "rs": [_LINE, _BLOCK, r'\bb?r(?P<h>#*)"[\s\S]*?"(?P=h)', _DOUBLE, _CHAR],
    "go": [_LINE, _BLOCK, _DOUBLE, _RAW, _CHAR],
    "ts": [_LINE, _BLOCK, _DOUBLE, _SINGLE, _TEMPLATE],
    "java": [_LINE, _BLOCK, _TRIPLE, _DOUBLE, _CHAR],
    "c": [_LINE, _BLOCK, r"^[ \t]*#(?:\\\n|[^\n])*", _DOUBLE, _CHAR],
    "cpp": [_LINE, _BLOCK, r"^[ \t]*#(?:\\\n|[^\n])*", r'\bR"(?P<h>[^(\s]*)\([\s\S]*?\)(?P=h)"', _DOUBLE, _CHAR],
    "cs": [_LINE, _BLOCK, r'\$?@"(?:""|[^"])*+"?', _DOUBLE, _CHAR],
    "php": [_LINE, _BLOCK, r"#(?!\[)[^\n]*", _DOUBLE, _SINGLE],
    "scala": [_LINE, _BLOCK, _TRIPLE, _DOUBLE, _CHAR],
    "rb": [r"(?m:^=begin[\s\S]*?^=end)", r"#[^\n]*", _DOUBLE, _SINGLE],
}
_MASK = {k: re.compile("|".join(f"(?:{p})" for p in v), re.M) for k, v in _MASKS.items()}
LANGUAGES = {"js": "ts", "jsx": "ts", "tsx": "ts", "mjs": "ts", "cjs": "ts", "svelte": "ts", "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "hxx": "cpp"} | {k: k for k in _MASKS}

_G = r"(?:\s*<[^<>{};]*+(?:<[^<>{};]*+>[^<>{};]*+)*+>)?"
_NAMES = r"[\w.$\\, \t\n<>:\[\]]+?"
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"


@dataclass(frozen=True)
class Grammar:
    """heads: (kind, pattern) of what opens braces; bare: of what stands between boundaries; members: heads and bare ones inside a type.

    Groups: ``n`` the name, ``up`` what it extends, ``of`` what it implements.
    """

    heads: tuple = ()
    members: tuple = ()
    bare: tuple = ()
    bare_members: tuple = ()
    imports: tuple = ()
    methods: str = "method"


def _c(*rows: tuple[str, str]) -> tuple:
    return tuple((k, re.compile(p, re.M)) for k, p in rows)


_ENDS = r"\s*$(?![\s\S])"
_CALLABLE = rf"\b(?P<n>[A-Za-z_~$][\w$]*)\s*\((?:[^(){{}};]|\((?:[^()]|\([^()]*\))*\))*\)"
GRAMMARS = {
    "rs": Grammar(
        heads=_c(("function", r"\bfn\s+(?P<n>\w+)"), ("struct", r"\b(?:struct|union)\s+(?P<n>\w+)"), ("enum", r"\benum\s+(?P<n>\w+)"), ("trait", r"\btrait\s+(?P<n>\w+)"), ("module", r"\bmod\s+(?P<n>\w+)"), ("impl", rf"\bimpl{_G}\s+(?:(?P<of>[\w:]+){_G}\s+for\s+)?&?(?P<n>[\w:]+)")),
        members=_c(("function", r"\bfn\s+(?P<n>\w+)")),
        bare=_c(("type_alias", rf"^[ \t]*{_PUB}type\s+(?P<n>\w+)"), ("constant", rf"^[ \t]*{_PUB}(?:const|static)\s+(?:mut\s+)?(?P<n>\w+)\s*:"), ("struct", rf"^[ \t]*{_PUB}struct\s+(?P<n>\w+)[^{{]*{_ENDS}"), ("module", rf"^[ \t]*{_PUB}mod\s+(?P<n>\w+){_ENDS}")),
        bare_members=_c(("function", rf"\bfn\s+(?P<n>\w+)[^{{]*{_ENDS}")),
        methods="function",
    ),
    "go": Grammar(
        heads=_c(("method", r"\bfunc\s*\([^)]*\)\s*(?P<n>\w+)\s*[(\[]"), ("function", r"\bfunc\s+(?P<n>\w+)\s*[(\[]"), ("struct", rf"\b(?P<n>\w+)(?:\[[^\]]*\])?\s+struct{_ENDS}"), ("interface", rf"\b(?P<n>\w+)(?:\[[^\]]*\])?\s+interface{_ENDS}")),
        bare=_c(("type_alias", r"^[ \t]*type\s+(?P<n>\w++)(?:\[[^\]]*\])?+\s*+=?\s*+(?!struct\b|interface\b)[\w\[\]*.(]"), ("constant", r"^[ \t]*(?:const|var)\s+(?P<n>\w+)")),
    ),
    "ts": Grammar(
        heads=_c(
            ("class", rf"\bclass\s+(?P<n>[\w$]+){_G}(?:\s+extends\s+(?P<up>[\w$.]+){_G})?(?:\s+implements\s+(?P<of>{_NAMES}))?{_ENDS}"), ("interface", rf"\binterface\s+(?P<n>[\w$]+){_G}(?:\s+extends\s+(?P<up>{_NAMES}))?{_ENDS}"), ("enum", rf"\benum\s+(?P<n>[\w$]+){_ENDS}"),
            ("function", r"\bfunction\s*\*?\s*(?P<n>[\w$]+)\s*(?:<[^(]*>)?\("), ("function", rf"\b(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b[^{{]*|(?:<[^>]*>\s*)?(?:\([^{{]*\)|[\w$]+)\s*(?::[^={{]+)?=>){_ENDS}"),
        ),
        members=_c(("method", rf"(?:^|[\n;}}])\s*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?(?P<n>[#\w$]+)\s*(?:<[^(]*>)?\([^{{}}]*\)\s*(?::[^={{]+)?{_ENDS}")),
        bare=_c(("type_alias", r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>[\w$]+)"), ("function", r"^[ \t]*(?:export\s+)?const\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>(?!\s*\{)"), ("constant", r"^[ \t]*(?:export\s+)?const\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=(?!>|\s*(?:async\b|function\b|\([^)\n]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>))")),
        imports=(r"""\b(?:from|import)\s*['"]([^'"\n]+)['"]""", r"""\brequire\(\s*['"]([^'"\n]+)['"]"""),
    ),
    "java": Grammar(
        heads=_c(("class", rf"\b(?:class|record)\s+(?P<n>\w+){_G}(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<up>[\w.]+){_G})?(?:\s+implements\s+(?P<of>{_NAMES}))?{_ENDS}"), ("interface", rf"\binterface\s+(?P<n>\w+){_G}(?:\s+extends\s+(?P<up>{_NAMES}))?{_ENDS}"), ("enum", rf"\benum\s+(?P<n>\w+)(?:\s+implements\s+(?P<of>{_NAMES}))?{_ENDS}"), ("function", rf"[\w>\]]\s+{_CALLABLE}{_ENDS}")),
        members=_c(("method", rf"{_CALLABLE}\s*(?:throws\s+[\w.,\s]+)?{_ENDS}")),
        bare_members=_c(("method", rf"[\w>\]]\s+{_CALLABLE}\s*(?:throws\s+[\w.,\s]+)?{_ENDS}"), ("variable", r"^[ \t]*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|volatile|transient)\s+)*[\w.<>\[\],? ]+?\s+(?P<n>\w+)\s*(?:=|$(?![\s\S]))")),
        imports=(r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)",),
    ),
    "c": Grammar(
        heads=_c(("struct", rf"\b(?:struct|union)\s+(?P<n>\w+){_ENDS}"), ("enum", rf"\benum\s+(?P<n>\w+){_ENDS}"), ("function", rf"[\w*]\s+\**{_CALLABLE}{_ENDS}")),
        bare=_c(("type_alias", rf"\btypedef\b[^;]*?\b(?P<n>\w+)\s*(?:\[[^\]]*\]\s*)*{_ENDS}")),
        imports=(r'^[ \t]*#[ \t]*include\s*[<"]([^>"\n]+)[>"]',),
    ),
    "cpp": Grammar(
        heads=_c(("enum", rf"\benum\s+(?:class\s+|struct\s+)?(?P<n>\w+)(?:\s*:\s*[\w:]+)?{_ENDS}"), ("class", rf"\bclass\s+(?P<n>\w+)(?:\s+final)?(?:\s*:(?!:)\s*(?P<up>{_NAMES}))?{_ENDS}"), ("struct", rf"\b(?:struct|union)\s+(?P<n>\w+)(?:\s*:(?!:)\s*(?P<up>{_NAMES}))?{_ENDS}"), ("module", rf"\bnamespace\s+(?P<n>[\w:]+){_ENDS}"), ("function", rf"[\w*&>]\s+[*&]*(?:\w+::)*{_CALLABLE}\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>*& ]+)?{_ENDS}")),
        members=_c(("method", rf"{_CALLABLE}\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>*& ]+)?(?::\s[^{{]*)?{_ENDS}")),
        bare=_c(("type_alias", rf"\btypedef\b[^;]*?\b(?P<n>\w+){_ENDS}"), ("type_alias", r"^[ \t]*using\s+(?P<n>\w+)\s*=")),
        imports=(r'^[ \t]*#[ \t]*include\s*[<"]([^>"\n]+)[>"]',),
    ),
    "cs": Grammar(
        heads=_c(("class", rf"\b(?:class|record)\s+(?P<n>\w+){_G}(?:\s*\([^)]*\))?(?:\s*:\s*(?P<up>{_NAMES}))?(?:\s+where\b[^{{]*)?{_ENDS}"), ("struct", rf"\bstruct\s+(?P<n>\w+){_G}(?:\s*:\s*(?P<up>{_NAMES}))?{_ENDS}"), ("interface", rf"\binterface\s+(?P<n>\w+){_G}(?:\s*:\s*(?P<up>{_NAMES}))?{_ENDS}"), ("enum", rf"\benum\s+(?P<n>\w+)(?:\s*:\s*\w+)?{_ENDS}"), ("module", rf"\bnamespace\s+(?P<n>[\w.]+){_ENDS}"), ("function", rf"[\w>\]]\s+{_CALLABLE}{_ENDS}")),
        members=_c(("method", rf"{_CALLABLE}\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?:where\b[^{{]*)?{_ENDS}"), ("variable", rf"[\w>\]?]\s+(?P<n>\w+){_ENDS}")),
        bare=_c(("module", rf"^[ \t]*namespace\s+(?P<n>[\w.]+){_ENDS}")),
        bare_members=_c(("method", rf"[\w>\]]\s+{_CALLABLE}{_ENDS}"), ("variable", r"^[ \t]*(?:(?:public|private|protected|internal|static|readonly|const)\s+)+[\w.<>\[\],? ]+?\s+(?P<n>\w+)\s*(?:=(?!>)|$(?![\s\S]))")),
        imports=(r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;",),
    ),
    "php": Grammar(
        heads=_c(("class", rf"\b(?:class|trait|enum)\s+(?P<n>\w+)(?:\s+extends\s+(?P<up>[\w\\]+))?(?:\s+implements\s+(?P<of>{_NAMES}))?{_ENDS}"), ("interface", rf"\binterface\s+(?P<n>\w+)(?:\s+extends\s+(?P<up>{_NAMES}))?{_ENDS}"), ("module", rf"\bnamespace\s+(?P<n>[\w\\]+){_ENDS}"), ("function", r"\bfunction\s+&?(?P<n>\w+)\s*\(")),
        members=_c(("method", r"\bfunction\s+&?(?P<n>\w+)\s*\(")),
        bare=_c(("module", rf"^[ \t]*(?:<\?php\s+)?namespace\s+(?P<n>[\w\\]+){_ENDS}")),
        bare_members=_c(("method", r"\bfunction\s+&?(?P<n>\w+)\s*\(")),
        imports=(r"^[ \t]*use\s+(?:function\s+|const\s+)?([\w\\]+)[^(;]*;",),
    ),
    "scala": Grammar(
        heads=_c(("class", rf"\bclass\s+(?P<n>\w+)[^{{]*?(?:\bextends\s+(?P<up>{_NAMES}(?:\([^)]*\))?(?:\s+with\s+{_NAMES})*))?{_ENDS}"), ("module", rf"\bobject\s+(?P<n>\w+)(?:\s+extends\s+(?P<up>{_NAMES}))?{_ENDS}"), ("trait", rf"\btrait\s+(?P<n>\w+){_G}(?:\s+extends\s+(?P<up>{_NAMES}))?{_ENDS}"), ("enum", rf"\benum\s+(?P<n>\w+)[^{{]*{_ENDS}"), ("function", r"\bdef\s+(?P<n>\w+)")),
        members=_c(("function", r"\bdef\s+(?P<n>\w+)")),
        bare=_c(("class", r"^[ \t]*case\s+class\s+(?P<n>\w+)(?=[^{]*$(?![\s\S]))")),
        bare_members=_c(("function", r"^[ \t]*(?:override\s+|private\s+|protected\s+|final\s+)*def\s+(?P<n>\w+)(?=[^{}]*=\s*[^\s{])")),
        imports=(r"^[ \t]*import\s+([\w.]+)",),
        methods="function",
    ),
}
TYPES = {"class", "struct", "interface", "trait", "enum", "impl"}
_NO_NAME = set("if else for foreach while switch match catch return new throw do try finally sizeof fn func function def class super this await yield case synchronized elseif const var let".split())
_MORE = {"go": {"go", "defer", "select", "range", "make"}, "rs": {"unsafe", "loop", "move", "in", "as"}, "cs": {"using", "lock", "when", "nameof", "typeof"}, "rb": {"unless", "until", "and", "or", "not", "puts"}, "php": {"array", "isset", "list", "echo"}}
#: A head is looked for in as many characters before its brace.
HEAD_CHARS = 4000
_CALL = re.compile(r"(?<![\w$.:>#])([A-Za-z_$][\w$]*(?:(?:::|\.|->)[A-Za-z_$][\w$]*)*)\s*!?\(")
_DEFINES = re.compile(r"\b(?:fn|func|function|def|class|record)\s+(?:\([^)]*\)\s*)?$")
_CUT = re.compile(r"[{};()]")


def mask(text: str, lang: str) -> str:
    """The text with comments and the inside of literals blanked; offsets and lines stay."""
    return _MASK[lang].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _bases(s: str | None) -> list[str]:
    """Names of a list of base types, without arguments and access words."""
    s = re.sub(r"\([^)]*\)", "", s or "")
    while (t := re.sub(r"<[^<>]*>", "", s)) != s:
        s = t
    parts = [re.sub(r"\b(?:public|private|protected|virtual|where\b.*)\s*", "", p).strip() for p in re.split(r",|\bwith\b|\bimplements\b", s)]
    return [p.split()[-1] for p in parts if p.strip()]


def _rust_uses(s: str) -> list[str]:
    """The paths that one ``use`` names, braces spelled out."""
    s = " ".join(s.split())
    if "{" not in s:
        return [re.sub(r"\s+as\s+\w+$", "", s).strip()] if s.strip() else []
    head, _, rest = s.partition("{")
    body, depth, parts, now = rest[: rest.rfind("}")], 0, [], ""
    for c in body:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p if x.strip() != "self" else head.strip().removesuffix("::") for x in [*parts, now] if x.strip() for p in _rust_uses(head.strip() + x.strip())]


class Scan:
    """One text: ``symbols`` (name, kind, line, signature), ``calls`` (caller, callee, line) and ``edges`` (source, kind, target, line)."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang, self.g = text, LANGUAGES[lang], GRAMMARS.get(LANGUAGES[lang])
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.no_name = _NO_NAME | _MORE.get(self.lang, set())
        self.symbols: list[tuple] = []
        self.calls: list[tuple] = []
        self.edges: list[tuple] = []
        self.bare = mask(text, self.lang)
        if self.lang == "rb":
            self._ruby()
        else:
            self._braces()
        self._imports()
        self.symbols = list(dict.fromkeys(self.symbols))
        self.calls, self.edges = list(dict.fromkeys(self.calls)), list(dict.fromkeys(self.edges))

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def _define(self, kind: str, name: str, at: int, end: int) -> None:
        first = self.starts[self.line(at) - 1]
        self.symbols.append((name, kind, self.line(at), " ".join(self.text[first:end].split())))

    def _relate(self, name: str, kind: str, m: re.Match, at: int) -> None:
        groups = m.groupdict()
        for base in _bases(groups.get("up")):
            implemented = self.lang == "cs" and re.match(r"I[A-Z]", base) and kind != "interface"
            self.edges.append((name, "IMPLEMENTS" if implemented else "INHERITS", base, self.line(at)))
        self.edges += [(name, "IMPLEMENTS", base, self.line(at)) for base in _bases(groups.get("of"))]

    def _braces(self) -> None:
        g, t = self.g, self.bare
        # Kind of the open braces, the function they stand in, and how many brackets were open.
        stack: list[tuple[str, str | None, int]] = []
        begin, brackets = 0, 0
        for m in _CUT.finditer(t):
            c, at = m[0], m.start()
            if c in "()":
                brackets = max(0, brackets + (1 if c == "(" else -1))
                continue
            if c == ";" and brackets:
                continue
            segment = t[begin:at]
            owner = stack[-1][0] if stack else ""
            caller = stack[-1][1] if stack else None
            if caller:
                self._calls(segment, begin, caller)
            member = owner in TYPES
            if not caller and not brackets:
                for kind, p in (*((g.bare if not member else ()) or ()), *(g.bare_members if member and c == ";" else ())):
                    found = False
                    for x in p.finditer(segment):
                        if x["n"] not in self.no_name and not (kind == "struct" and c == "{"):
                            self._define(kind, x["n"], begin + x.start("n"), at)
                            found = True
                    if found and kind in ("method", "function") and member:
                        break
                if self.lang == "scala" and member:
                    for x in g.bare_members[0][1].finditer(segment) if c != ";" else ():
                        self._define("function", x["n"], begin + x.start("n"), at)
            if c == "{":
                kind, name = "", ""
                if not brackets or self.lang == "go":
                    kind, name = self._head(segment, begin, at, member, bool(caller))
                stack.append((kind, name if kind in ("function", "method") else caller, brackets))
                brackets = 0
            elif c == "}":
                if stack:
                    _, _, brackets = stack.pop()
            begin = at + 1
        if not (stack and stack[-1][1]):
            for kind, p in g.bare:
                for x in p.finditer(t[begin:]):
                    self._define(kind, x["n"], begin + x.start("n"), len(t))

    def _head(self, segment: str, begin: int, at: int, member: bool, inside: bool) -> tuple[str, str]:
        """Kind and name of what opens a brace: the definition that ends last before it."""
        begin, segment, best = max(begin, at - HEAD_CHARS), segment[-HEAD_CHARS:], None
        for kind, p in (*(self.g.members if member else ()), *self.g.heads):
            last = None
            for last in p.finditer(segment):
                pass
            if last and last["n"] not in self.no_name and (best is None or last.start("n") > best[1].start("n")):
                best = (kind, last)
        if best is None:
            return "", ""
        kind, m = best
        name = m["n"]
        if kind == "impl":
            name = name.rsplit("::", 1)[-1]
        else:
            if kind == "function" and member:
                kind = self.g.methods
            if not inside or kind not in ("function", "method", "variable") or self.lang in ("rs", "ts", "go"):
                self._define(kind, name, begin + m.start("n"), at)
        self._relate(name, kind, m, begin + m.start("n"))
        return kind, name

    def _calls(self, segment: str, begin: int, caller: str) -> None:
        for x in _CALL.finditer(segment):
            last = re.split(r"::|\.|->", x[1])[-1]
            if last not in self.no_name and last not in BUILTINS and x[1] != caller and not _DEFINES.search(segment[max(0, x.start() - 80) : x.start()]):
                self.calls.append((caller, x[1], self.line(begin + x.start())))

    def _ruby(self) -> None:
        stack: list[tuple[int, str, str]] = []
        for n, raw in enumerate(self.bare.split("\n"), 1):
            if not raw.strip():
                continue
            indent = len(raw) - len(raw.lstrip())
            while stack and indent <= stack[-1][0] and not (indent == stack[-1][0] and re.match(r"\s*(?:end|else|elsif|rescue|ensure|when)\b", raw)):
                stack.pop()
            m = re.match(r"\s*(module|class)\s+([A-Z][\w:]*)(?:\s*<\s*([\w:]+))?", raw) or re.match(r"\s*(def)\s+(?:self\.)?([\w]+[?!=]?)", raw)
            if m:
                inside = any(k in ("class", "module") for _, k, _ in stack)
                kind = m[1] if m[1] != "def" else "method" if inside else "function"
                self.symbols.append((m[2], kind, n, self.text[self.starts[n - 1] :].split("\n", 1)[0].strip()))
                if m[1] == "class" and m[3]:
                    self.edges.append((m[2], "INHERITS", m[3], n))
                stack.append((indent, kind, m[2]))
            elif re.match(r"\s*end\b", raw):
                if stack and stack[-1][0] == indent:
                    stack.pop()
            else:
                caller = next((x for _, k, x in reversed(stack) if k in ("method", "function")), None)
                if caller:
                    self._calls(raw, self.starts[n - 1], caller)
        self.edges += [("", "IMPORTS", m[1], self.line(m.start(1))) for m in re.finditer(r"""^\s*require(?:_relative)?\s*\(?\s*['"]([^'"\n]+)['"]""", self.text, re.M)]

    def _imports(self) -> None:
        if self.lang == "rs":
            for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", self.bare, re.M):
                self.edges += [("", "IMPORTS", p, self.line(m.start(1))) for p in _rust_uses(m[1])]
        elif self.lang == "go":
            for m in re.finditer(r'^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)"', self.text, re.M):
                self.edges.append(("", "IMPORTS", m[1], self.line(m.start(1))))
            for block in re.finditer(r"^[ \t]*import\s*\(([^)]*)\)", self.text, re.M):
                self.edges += [("", "IMPORTS", m[1], self.line(block.start(1) + m.start(1))) for m in re.finditer(r'"([^"\n]+)"', block[1])]
            for block in re.finditer(r"^[ \t]*(?:const|var)\s*\(([^)]*)\)", self.bare, re.M):
                for m in re.finditer(r"^[ \t]*([A-Za-z_]\w*)", block[1], re.M):
                    self._define("constant", m[1], block.start(1) + m.start(1), block.start(1) + m.end(1))
        elif self.g:
            for p in self.g.imports:
                self.edges += [("", "IMPORTS", m[1], self.line(m.start(1))) for m in re.finditer(p, self.text, re.M)]


def scan(text: str | None, lang: str | None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(symbols, calls, edges) of a text; nothing for null texts and other languages.

    In Svelte only the script blocks count, under the lines of the whole file.
    """
    if not text:
        return [], [], []
    if lang in ("py", "pyi"):
        return python_graph(text)
    if lang not in LANGUAGES:
        return [], [], []
    if lang == "svelte":
        keep = [m.span(1) for m in re.finditer(r"<script[^>]*>([\s\S]*?)</script>", text)]
        out, at = [], 0
        for a, b in keep:
            out += [re.sub(r"[^\n]", " ", text[at:a]), text[a:b]]
            at = b
        text = "".join([*out, re.sub(r"[^\n]", " ", text[at:])])
    s = Scan(text, lang)
    return s.symbols, s.calls, s.edges


def symbols(files: DataFrame) -> DataFrame:
    """(file, line, kind, name, signature) of files (file, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, n, k, name, sig) for f, lang, t in zip(b["file"], b["language"], b["content"], strict=True) for name, k, n, sig in scan(t, lang)[0]]
            yield pd.DataFrame(rows, columns=["file", "line", "kind", "name", "signature"])

    return files.select("file", "language", "content").mapInPandas(run, "file string, line int, kind string, name string, signature string")


def edges(files: DataFrame) -> DataFrame:
    """(file, source, kind, target, line): CALLS, IMPORTS, INHERITS and IMPLEMENTS edges of files (file, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, lang, t in zip(b["file"], b["language"], b["content"], strict=True):
                _, calls, typed = scan(t, lang)
                rows += [(f, a, "CALLS", c, n) for a, c, n in calls] + [(f, *e) for e in typed]
            yield pd.DataFrame(rows, columns=["file", "source", "kind", "target", "line"])

    return files.select("file", "language", "content").mapInPandas(run, "file string, source string, kind string, target string, line int")
