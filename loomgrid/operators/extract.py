"""Source text to relations: symbols, calls, typed edges, references and routes.

Definitions are found line by line with a table of patterns; a file is split
once and only lines on which a pattern of its language hits become rows.  What
needs the state of a whole file (call scopes, Python's own grammar, routes with
line numbers) runs file by file in Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PER_FILE = 50
_P = r"(?:public|private|protected)?\s*"
# Definitions by language: (kind, pattern); the first group is the name.
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "rs": [("function", r"^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("type_alias", r"^\s*(?:pub\s+)?type\s+(\w+)"), ("constant", r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)")],
    "py": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "ts": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)"), ("constant", r"^\s*(?:export\s+)?const\s+(\w+)")],
    "go": [("function", r"^\s*func\s+(?:\([^)]+\)\s+)?(\w+)"), ("struct", r"^\s*type\s+(\w+)\s+struct"), ("interface", r"^\s*type\s+(\w+)\s+interface"), ("constant", r"^\s*const\s+(\w+)")],
    "java": [("class", rf"^\s*{_P}(?:abstract\s+)?class\s+(\w+)"), ("method", rf"^\s*{_P}(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(")],
    "c": [("function", r"^\s*(?:static\s+)?[\w\*]+\s+(\w+)\s*\([^;]*\)\s*\{"), ("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)")],
    "rb": [("function", r"^\s*def\s+(?:self\.)?(\w+)"), ("class", r"^\s*(?:class|module)\s+(\w+)")],
    "php": [("function", rf"^\s*{_P}(?:static\s+)?function\s+(\w+)"), ("class", r"^\s*(?:abstract\s+)?(?:final\s+)?class\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)")],
    "swift": [("function", r"^\s*(?:public|private|internal|fileprivate)?\s*(?:static\s+)?func\s+(\w+)"), ("class", r"^\s*(?:public|internal|final|open)?\s*(?:class|struct|enum|protocol)\s+(\w+)")],
    "scala": [("function", r"^\s*(?:private|protected)?\s*def\s+(\w+)"), ("class", r"^\s*(?:abstract\s+)?(?:sealed\s+)?(?:class|object|trait|case class)\s+(\w+)")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+(?:[\w.:]+\.)?(\w+)")],
    "zig": [("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("constant", r"^\s*(?:pub\s+)?const\s+(\w+)")],
    "dart": [("class", r"^\s*(?:abstract\s+)?(?:class|mixin)\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("class", r"^\s*extension\s+(?:type\s+)?(\w+)\s+on\s+\w+"), ("class", r"^\s*extension\s+(?:type\s+)?on\s+(\w+)"), ("type_alias", r"^\s*typedef\s+(\w+)"), ("function", r"^\s*(?:[A-Z]\w*\s+)?(?:[a-zA-Z]\w*(?:<[^>]+>)?)\s+get\s+(\w+)"), ("function", r"^\s*(?:static\s+)?(?:external\s+)?(?:late\s+)?(?:final\s+)?(?:const\s+)?(?:void|[a-zA-Z]\w*(?:<[^>]+>)?)\s+(\w+)\s*\(")],
    "svelte": [("variable", r"^\s*export\s+let\s+(\w+)"), ("variable", r"^\s*let\s+(\w+)\s*=\s*\$state(?:<[^>]*>)?\s*\("), ("variable", r"^\s*let\s+(\w+)\s*=\s*\$derived(?:<[^>]*>)?\s*\("), ("function", r"^\s*(\$effect)\s*\("), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("constant", r"^\s*(?:export\s+)?const\s+(\w+)")],
}
ALIASES = {"pyi": "py", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "kt": "java", "kts": "java", "cpp": "c", "cc": "c", "cxx": "c", "h": "c", "hpp": "c"}
# Names that are no calls of the project's own.
BUILTINS = set("""if for while match return break continue print println eprintln format write writeln vec Box Some None Ok Err Result
Option String str Vec HashMap HashSet dbg todo unimplemented unreachable panic assert assert_eq assert_ne len is_empty push pop
insert remove get set new default clone into from iter collect map filter fold next unwrap expect as_ref as_mut as_str to_string
to_owned to_vec drop copy send sync main debugPrint throw rethrow late required covariant show hide Future Stream Completer List
Map Set int double num bool dynamic Object Null Never""".split())
# Where a line opens a function body, by language.
_ENTRY = {
    "rs": r"\bfn\s+(\w+)\s*[<(]", "go": r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", "c": r"\b(\w+)\s*\([^;{}]*\)\s*\{", "py": r"\bdef\s+(\w+)",
    **dict.fromkeys(("java", "dart"), r"\b(\w+)\s*\([^;{}]*\)\s*\{"),
}
_CALL = re.compile(r"(?<![\w.])([A-Za-z_][\w]*(?:(?:::|\.)[A-Za-z_]\w*)*)\s*\(")
_KEYWORDS = set("if while for loop match return break switch new instanceof require import range defer go print len catch elif and or not in fn func def function".split())
_IMPORTS = {
    "rs": [r"\b(?:pub\s+)?use\s+([\w:]+)", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;"], "py": [r"^\s*from\s+([\w.]+)\s+import", r"^\s*import\s+([\w.]+)"],
    "ts": [r"""from\s+['"]([^'"]+)['"]""", r"""^\s*import\s+['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)"""],
    "go": [r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$"""], "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)"], "dart": [r"""^\s*import\s+['"]([^'"]+)['"]"""],
}
_TYPES = {"rs": r"(?::|->|<|&)\s*(?:mut\s+)?([A-Z]\w+)", "py": r"(?::|->)\s*([A-Z]\w+)", "go": r"(?:\*|\[\])([A-Z]\w+)|\b([A-Z]\w+)\{", "java": r"\b([A-Z]\w+)\s+\w+\s*[=;,)(]"}
_PLAIN_TYPES = {"String", "Integer", "Boolean", "List", "Map"}
# Route registrations by language: (pattern, groups of path, method, handler).
ROUTES = {
    "rs": [(r'(?:\w+\.)?route\(\s*"([^"]+)"\s*,\s*(?:\w+::)?(\w+)\(([\w:]+)', (1, 2, 3)), (r'\.route\(\s*"([^"]+)"\s*,\s*\w+::(\w+)\(\)\.to\(([\w:]+)', (1, 2, 3))],
    "go": [(r'HandleFunc\(\s*"([^"]+)"\s*,\s*(\w+)', (1, 0, 2)), (r'\w+\.\w+\(\s*"([^"]+)"\s*,\s*(\w+)', (1, 0, 2))],
    "ts": [(r"""(?:app|router|fastify)\.(\w+)\(\s*['"]([^'"]+)['"]\s*,\s*(\w+)""", (2, 0, 3))],
    "py": [(r"""@\w+\.route\(\s*['"]([^'"]+)['"]""", (1, 0, 0)), (r"""@\w+\.(?!route\b)\w+\(\s*['"]([^'"]+)['"]""", (1, 0, 0))],
}


def base_language(lang: str | None) -> str:
    return ALIASES.get(lang or "", lang or "")


def _base_col():
    out = F.col("language")
    for k, v in ALIASES.items():
        out = F.when(F.col("language") == k, v).otherwise(out)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """(file, line, kind, name, signature) of definitions in files (file, language, content).

    A line gives each name once, under the first kind of its language's table.  A
    Svelte file also defines its component, named after the file.
    """
    lines = files.select("file", _base_col().alias("_b"), F.posexplode(F.split("content", "\n")).alias("_p", "content"))
    found = [F.when((F.col("_b") == b) & (n := F.regexp_extract("content", p, 1)).isNotNull() & (n != ""), F.struct(F.lit(k).alias("kind"), n.alias("name"), F.lit(i).alias("_o"))) for b, rows in DEFINITIONS.items() for i, (k, p) in enumerate(rows)]
    any_of = F.col("content").rlike("|".join({"(?:" + re.sub(r"(?<!\\)\((?!\?)", "(?:", p) + ")" for rows in DEFINITIONS.values() for _, p in rows}))
    d = lines.where(F.col("_b").isin(list(DEFINITIONS)) & any_of).select("file", (F.col("_p") + 1).alias("line"), "content", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_s"))
    g = d.groupBy("file", "line", F.col("_s.name").alias("name")).agg(F.min_by("_s.kind", "_s._o").alias("kind"), F.first("content").alias("signature"))
    out = g.select("file", "line", "kind", "name", F.trim("signature").alias("signature"))
    stem = F.regexp_extract("file", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    name = F.array_join(F.transform(F.split(stem, "[-_]"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")
    own = files.where("language = 'svelte'").select("file", F.lit(1).alias("line"), F.lit("struct").alias("kind"), name.alias("name"))
    return out.unionByName(own.where("name != ''").withColumn("signature", F.format_string("<!-- %s component -->", "name")))


def line_references(line: str, lang: str) -> list[tuple[str, str]]:
    """(kind, name) of imports, calls and types on a line, each once."""
    b = base_language(lang)
    out = [("import", next(g for g in m.groups() if g)) for p in _IMPORTS.get(b, []) for m in re.finditer(p, line)]
    out += [("call", m[1]) for m in _CALL.finditer(line) if m[1] not in _KEYWORDS and not re.search(r"(?:fn|def|func|function|class)\s+$", line[: m.start()]) and (b in _IMPORTS or len(m[1]) > 2)]
    if b in _TYPES:
        out += [("type", t) for m in re.finditer(_TYPES[b], line) if (t := next(g for g in m.groups() if g)) not in _PLAIN_TYPES]
    return list(dict.fromkeys(out))


def calls_of(content: str, lang: str) -> list[tuple[str, str, int]]:
    """(caller, callee, line): calls inside functions, by entry patterns and brace depth; calls of itself and of builtins are left out."""
    b = base_language(lang)
    entry = re.compile(_ENTRY[b]) if b in _ENTRY and b != "py" else None
    out, caller, depth = [], None, 0
    for no, line in enumerate(content.split("\n"), 1):
        if entry and (m := entry.search(line.strip())):
            caller, depth = m[1], 0
        depth += line.count("{") - line.count("}")
        if depth <= 0:
            caller = None
        if caller:
            out += [(caller, n, no) for k, n in line_references(line, lang) if k == "call" and n != caller and n not in BUILTINS]
    return out


def python_graph(content: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(symbols, calls, edges) of Python source by its grammar; empty for source that does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return [], [], []
    lines = content.split("\n")
    sym, calls, edges = [], [], []

    def visit(node: ast.AST, owner: str | None, func: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                sym.append((n.name, "method" if owner else "function", n.lineno, lines[n.lineno - 1].strip()))
                visit(n, None, n.name)
                continue
            if isinstance(n, ast.ClassDef):
                sym.append((n.name, "class", n.lineno, lines[n.lineno - 1].strip()))
                edges.extend((n.name, "INHERITS", ast.unparse(x), n.lineno) for x in n.bases)
                visit(n, n.name, func)
                continue
            if isinstance(n, ast.Import):
                edges.extend(("", "IMPORTS", a.name, n.lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                edges.append(("", "IMPORTS", n.module or "", n.lineno))
            elif isinstance(n, ast.Call) and func:
                callee = ast.unparse(n.func)
                if callee not in BUILTINS and callee != func:
                    calls.append((func, callee, n.lineno))
            visit(n, owner, func)

    visit(tree, None, None)
    return sym, calls, edges


def routes_of(content: str, lang: str) -> list[tuple[str, str, int]]:
    """(handler, target, line) of route registrations, over the whole text; target is ``METHOD /path`` or the path."""
    out = []
    for p, (path, method, handler) in ROUTES.get(base_language(lang), []):
        for m in re.finditer(p, content):
            no = content.count("\n", 0, m.start()) + 1
            target = f"{m[method].upper()} {m[path]}" if method else m[path]
            out.append((m[handler].rsplit("::", 1)[-1] if handler else f"route_line_{no}", target, no))
    return out


def edges(files: DataFrame) -> DataFrame:
    """(file, source, kind, target, line): CALLS, IMPORTS, INHERITS and ROUTE edges of files (file, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, lang, text in zip(b["file"], b["language"], b["content"], strict=True):
                if text is None:
                    continue
                if base_language(lang) == "py":
                    _, calls, typed = python_graph(text)
                    rows += [(f, a, "CALLS", c, n) for a, c, n in calls] + [(f, *e) for e in typed]
                else:
                    rows += [(f, a, "CALLS", c, n) for a, c, n in calls_of(text, lang)]
                    rows += [(f, "", "IMPORTS", t, n) for n, line in enumerate(text.split("\n"), 1) for k, t in line_references(line, lang) if k == "import"]
                rows += [(f, h, "ROUTE", t, n) for h, t, n in routes_of(text, lang)]
            yield pd.DataFrame(rows, columns=["file", "source", "kind", "target", "line"])

    return files.select("file", "language", "content").mapInPandas(run, "file string, source string, kind string, target string, line int")


def diff_references(added: DataFrame, cap: int = MAX_PER_FILE) -> DataFrame:
    """(file, line, kind, name) of the first ``cap`` distinct references of each file's added lines."""
    from pyspark.sql import Window as W

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, n, i, k, s) for f, lang, n, t in zip(b["file"], b["language"], b["line"], b["content"], strict=True) for i, (k, s) in enumerate(line_references(t or "", lang))]
            yield pd.DataFrame(rows, columns=["file", "line", "seq", "kind", "name"])

    d = added.select("file", "language", "line", "content").mapInPandas(run, "file string, line int, seq int, kind string, name string")
    first = d.groupBy("file", "kind", "name").agg(F.min(F.struct("line", "seq")).alias("_at"))
    w = W.partitionBy("file").orderBy("_at", "kind", "name")
    return first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).select("file", F.col("_at.line").alias("line"), "kind", "name")


# Names that are no definitions.
_NO_DEFINITION = ["if", "for", "while", "match", "new", "return", "test", "main"]


def diff_definitions(added: DataFrame) -> DataFrame:
    """(file, name, kind) of functions and types that added lines define, each once a file, by its first line."""
    s = symbols(added.groupBy("file", "language").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("content")))
    kind = F.when(F.col("kind").isin("function", "method"), "function").otherwise("type")
    return s.where(F.col("kind").isin("function", "method", "class", "struct", "enum", "trait", "interface", "type_alias") & ~F.col("name").isin(_NO_DEFINITION)).groupBy("file", "name").agg(F.min_by(kind, F.struct("line", kind)).alias("kind"))


def definition_extent(content: str, line: int, most: int = 50) -> tuple[int, int]:
    """First and last line of a definition that starts at ``line``, by brace depth or by indent, at most ``most`` lines."""
    lines = content.split("\n")
    head = lines[line - 1]
    if head.rstrip().endswith(":"):
        indent = len(head) - len(head.lstrip())
        end = line
        for i in range(line, min(len(lines), line - 1 + most)):
            if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= indent:
                break
            end = i + 1
        return line, end
    depth, seen = 0, False
    for i in range(line - 1, min(len(lines), line - 1 + most)):
        depth += lines[i].count("{") - lines[i].count("}")
        seen = seen or "{" in lines[i]
        if seen and depth <= 0:
            return line, i + 1
    return line, min(len(lines), line - 1 + most)


def test_candidates(path: str) -> list[str]:
    """Names under which the tests of a source file are usually found."""
    d, _, name = path.rpartition("/")
    stem, _, ext = name.rpartition(".")
    pre = d + "/" if d else ""
    table = {
        "rs": [f"tests/{stem}.rs", f"tests/{stem}_test.rs", f"{pre}{stem}_test.rs"], "py": [f"tests/test_{stem}.py", f"{pre}test_{stem}.py", f"{pre}{stem}_test.py"],
        "go": [f"{pre}{stem}_test.go"], "ts": [f"{pre}{stem}.{k}.{ext}" for k in ("test", "spec")] + [f"{pre}__tests__/{stem}.test.{ext}"], "java": [path.replace("src/main/", "src/test/").replace(f"{stem}.", f"{stem}Test.")],
    }
    return table.get(base_language(ext), [])


def import_candidates(target: str, lang: str) -> list[str]:
    """Files that an import may name."""
    b = base_language(lang)
    if b == "rs":
        p = re.sub(r"^(?:crate|self|super)::", "", target).replace("::", "/")
        return [f"src/{x}" for q in (p, p.rpartition("/")[0]) if q for x in (f"{q}.rs", f"{q}/mod.rs")]
    if b == "py":
        p = target.replace(".", "/")
        return [f"{p}.py", f"{p}/__init__.py", f"src/{p}.py"]
    if b == "ts":
        p = re.sub(r"^\./", "", target)
        return [f"{p}{x}" for x in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")]
    if b == "go":
        return [f"{target.split('/', 3)[-1]}/"]
    if b == "java":
        p = target.replace(".", "/")
        return [f"src/main/java/{p}.java", f"src/main/kotlin/{p}.kt", f"{p}.java"]
    return []
