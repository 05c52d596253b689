"""Column expressions on file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language code by file ending.
LANGUAGES: dict[str, list[str]] = {
    "rs": ["rs"], "py": ["py", "pyi"], "ts": ["ts", "tsx"], "js": ["js", "jsx", "mjs", "cjs"], "go": ["go"], "java": ["java"],
    "kt": ["kt", "kts"], "c": ["c"], "cpp": ["cpp", "cc", "cxx"], "h": ["h", "hpp", "hxx"], "rb": ["rb"], "php": ["php"],
    "swift": ["swift"], "scala": ["scala"], "r": ["r"], "sql": ["sql"], "sh": ["sh", "bash", "zsh"], "toml": ["toml"],
    "yaml": ["yaml", "yml"], "json": ["json"], "md": ["md", "markdown"], "html": ["html", "htm"], "css": ["css", "scss", "sass", "less"],
    "dart": ["dart"], "svelte": ["svelte"], "lua": ["lua"], "zig": ["zig"], "ex": ["ex", "exs"], "proto": ["proto"],
    "graphql": ["graphql", "gql"], "dockerfile": ["dockerfile"], "image": ["png", "jpg", "jpeg", "gif", "svg", "ico", "webp"],
    "document": ["pdf", "doc", "docx"], "lock": ["lock", "sum"],
}
# Language family by file ending.
FAMILIES: dict[str, list[str]] = {
    "rust": ["rs"], "javascript": ["js", "ts", "tsx", "jsx", "mjs", "cjs"], "python": ["py", "pyi"], "go": ["go", "mod", "sum"],
    "jvm": ["java", "kt", "scala", "gradle"], "web": ["html", "css", "scss", "less", "vue", "svelte"],
    "c_family": ["c", "cpp", "h", "hpp", "cc", "cxx"], "shell": ["sh", "bash", "zsh", "ps1"], "config": ["yaml", "yml", "json", "toml", "ini"],
    "documentation": ["md", "rst", "txt", "adoc"], "database": ["sql", "graphql", "proto"],
}
#: Order of the families when files are sorted for packing.
FAMILY_ORDER = [*FAMILIES, "other"]
# Words that make a path a test path, and endings of prose.
TEST_WORDS = ["test", "tests", "testing", "tested", "__tests__", "spec", "specs", "fixture", "fixtures", "mock", "mocks", "example", "examples"]
DOC_ENDINGS = ["md", "markdown", "mdx", "txt", "rst", "adoc", "asciidoc", "tex", "org"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mapped(key: Column, table: dict[str, list[str]], default: str) -> Column:
    out = None
    for name, keys in table.items():
        out = F.when(key.isin(keys), name) if out is None else out.when(key.isin(keys), name)
    return out.otherwise(default)


def language(path: Column | str) -> Column:
    """Language code of a path; a path without a dot is looked up whole, null and unknown endings give 'unknown'."""
    return _mapped(F.lower(F.substring_index(_col(path), ".", -1)), LANGUAGES, "unknown")


def family(path: Column | str) -> Column:
    p = _col(path)
    return F.when(p.contains("."), _mapped(F.lower(F.substring_index(p, ".", -1)), FAMILIES, "other")).otherwise("other")


def directory(path: Column | str) -> Column:
    """All but the last segment, '.' for a bare name."""
    p = _col(path)
    by_slash, by_back = F.regexp_replace(p, r"/[^/]*$", ""), F.regexp_replace(p, r"\\[^\\]*$", "")
    return F.when(p.contains("/"), by_slash).when(p.contains("\\"), by_back).otherwise(".")


def module(path: Column | str) -> Column:
    """First path segment, or the whole path where there is none."""
    return F.substring_index(_col(path), "/", 1)


def is_test(path: Column | str) -> Column:
    """Whether a segment between ``/ _ - .`` is a test word; 'latest' is none."""
    return F.arrays_overlap(F.split(F.lower(_col(path)), r"[/_\-.]"), F.array(*[F.lit(w) for w in TEST_WORDS]))


def is_doc(path: Column | str) -> Column:
    p = F.lower(_col(path))
    return p.contains(".") & F.substring_index(p, ".", -1).isin(DOC_ENDINGS)


def is_markdown(path: Column | str) -> Column:
    return _col(path).rlike(r"(?i)\.(md|mdx|markdown)$")


def like(c: Column | str, pattern: str) -> Column:
    """Case-insensitive LIKE in which a backslash is an ordinary character; % and _ are wildcards."""
    return _col(c).ilike(pattern.replace("\\", "\\\\"))


def contains_like(c: Column | str, needle: str) -> Column:
    """``c LIKE %needle%``; wildcards in the needle stay wildcards."""
    return like(c, f"%{needle}%")


def exclude_regex(pattern: str) -> str:
    """Regular expression of a rule's exclude pattern.

    ``dir/`` matches at segment boundaries, ``a/**`` by prefix, ``*x*`` anywhere,
    ``*_test.*`` file names with that stem, and anything else as a path or a directory.
    """
    q = re.escape
    if pattern.startswith("*") and "." in pattern[1:]:
        stem, _, ext = pattern[1:].partition(".")
        return rf"(?:^|/)[^/]*{q(stem)}\.{'[^/]*' if ext == '*' else q(ext)}$"
    if pattern.endswith("/"):
        return rf"(?:^|/){q(pattern)}"
    if "**" in pattern:
        return "^" + q(pattern.split("**")[0])
    if len(pattern) > 1 and pattern.startswith("*") and pattern.endswith("*"):
        return q(pattern[1:-1])
    return rf"^{q(pattern)}(?:/|$)"


def skip_regex(pattern: str) -> str:
    """Regular expression of an index skip pattern: a path, a base name, ``**/*.ext``, ``*.ext``, ``name.*``, ``**/dir/**``, ``dir/**`` or ``**/name``."""
    q = re.escape
    if pattern.startswith("**/*."):
        return q(pattern[4:]) + "$"
    if pattern.startswith("*."):
        return q(pattern[1:]) + "$"
    if pattern.startswith("**/") and pattern.endswith("/**"):
        return rf"(?:^|/){q(pattern[3:-3])}/"
    if pattern.endswith("/**"):
        return rf"^{q(pattern[:-3])}/"
    if pattern.startswith("**/"):
        return rf"(?:^|/){q(pattern[3:])}$"
    if pattern.endswith(".*"):
        return rf"(?:^|/){q(pattern[:-2])}\.[^/]*$"
    return rf"(?:^|/){q(pattern)}$"


def entry_point(name: Column | str, patterns: list[str]) -> Column:
    """Whether a name matches one of ``*x*``, ``*x``, ``x*`` or exact patterns, without regard to case."""
    n, hit = F.lower(_col(name)), F.lit(False)
    for p in (x.lower() for x in patterns):
        if len(p) > 2 and p.startswith("*") and p.endswith("*"):
            hit = hit | n.contains(p[1:-1])
        elif p.startswith("*"):
            hit = hit | n.endswith(p[1:])
        elif p.endswith("*"):
            hit = hit | n.startswith(p[:-1])
        else:
            hit = hit | (n == p)
    return hit


def ignored(path: Column | str, patterns: list[str]) -> Column:
    """Context ignore patterns: the part before a wildcard as a prefix, or the bare pattern as a substring."""
    p, hit = _col(path), F.lit(False)
    for x in patterns:
        bare = x.replace("**", "").replace("*", "").strip("/")
        if bare:
            hit = hit | p.startswith(bare) | p.contains(bare)
    return hit
