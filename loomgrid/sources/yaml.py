"""The part of YAML that configurations use: nested mappings, lists, scalars, quotes and comments.

Anchors, tags, block scalars and flow mappings over several lines are no part of it;
they are errors and never silently read as something else.
"""

from __future__ import annotations

import re

_INT, _FLOAT = re.compile(r"[-+]?\d+"), re.compile(r"[-+]?\d*\.\d+(?:[eE][-+]?\d+)?")
_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#"'\[\]{},:&*!|>%@`-][^#]*?|-[^\s#:][^#:]*?)\s*:(?:\s+(.*))?$""")
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "/": "/", "0": "\0", "r": "\r"}


class YamlError(ValueError):
    def __init__(self, line: int, what: str):
        super().__init__(f"line {line}: {what}")


def _strip(raw: str) -> str:
    """A line without its comment; a number sign inside quotes or a word opens none."""
    quote = ""
    for i, c in enumerate(raw):
        if quote:
            if c == quote and not (quote == '"' and raw[i - 1] == "\\"):
                quote = ""
        elif c in "\"'" and (i == 0 or raw[i - 1] in " [,:{-'"):  # a doubled quote goes on with its text
            quote = c
        elif c == "#" and (i == 0 or raw[i - 1].isspace()):
            return raw[:i].rstrip()
    return raw.rstrip()


def scalar(s: str, line: int = 0):
    """The value of a scalar or of a list or mapping in one line."""
    s = s.strip()
    if s.startswith('"'):
        if len(s) < 2 or not s.endswith('"'):
            raise YamlError(line, "unclosed quote")
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), s[1:-1])
    if s.startswith("'"):
        if len(s) < 2 or not s.endswith("'"):
            raise YamlError(line, "unclosed quote")
        return s[1:-1].replace("''", "'")
    if s.startswith("[") or s.startswith("{"):
        if s[-1] != {"[": "]", "{": "}"}[s[0]]:
            raise YamlError(line, "unclosed bracket")
        parts = _split(s[1:-1], line)
        if s[0] == "[":
            return [scalar(p, line) for p in parts]
        pairs = [p.partition(":") for p in parts]
        if any(not sep for _, sep, _ in pairs):
            raise YamlError(line, "a mapping needs keys")
        return {str(scalar(k, line)): scalar(v, line) for k, _, v in pairs}
    if s[:1] in ("&", "*", "!", "|", ">", "%", "@", "`"):
        raise YamlError(line, f"{s[0]!r} is not supported")
    low = s.lower()
    if low in ("", "~", "null"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if _INT.fullmatch(s):
        return int(s)
    return float(s) if _FLOAT.fullmatch(s) else s


def _split(s: str, line: int) -> list[str]:
    out, depth, quote, now = [], 0, "", ""
    for c in s:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(now)
            now = ""
        else:
            now += c
    if depth or quote:
        raise YamlError(line, "unclosed bracket or quote")
    return [*out, now] if now.strip() else out


def load(text: str):
    """The document as dictionaries, lists and scalars; None for an empty one.  A key given twice is an error."""
    lines = []
    for n, raw in enumerate(text.split("\n"), 1):
        s = _strip(raw.removesuffix("\r"))
        if not s.strip() or s.strip() == "---":
            continue
        body = s.lstrip(" ")
        if body.startswith("\t"):
            raise YamlError(n, "tabs do not indent")
        lines.append((len(s) - len(body), body, n))
    if not lines:
        return None
    value, i = _block(lines, 0, lines[0][0])
    if i < len(lines):
        raise YamlError(lines[i][2], "unexpected indent")
    return value


def _block(lines: list, i: int, indent: int):
    """The value that begins at line i, and the line after it."""
    if lines[i][1].startswith("- ") or lines[i][1] == "-":
        out = []
        while i < len(lines) and lines[i][0] == indent and (lines[i][1].startswith("- ") or lines[i][1] == "-"):
            rest, n = lines[i][1][1:].lstrip(), lines[i][2]
            inner = indent + len(lines[i][1]) - len(rest)
            if rest and _KEY.match(rest) and rest[0] not in "[{":
                lines[i] = (inner, rest, n)
                v, i = _block(lines, i, inner)
            elif rest:
                v, i = scalar(rest, n), i + 1
            elif i + 1 < len(lines) and lines[i + 1][0] > indent:
                v, i = _block(lines, i + 1, lines[i + 1][0])
            else:
                v, i = None, i + 1
            out.append(v)
        return out, i
    out = {}
    if not _KEY.match(lines[i][1]):
        return scalar(lines[i][1], lines[i][2]), i + 1
    while i < len(lines) and lines[i][0] == indent:
        m, n = _KEY.match(lines[i][1]), lines[i][2]
        if not m:
            raise YamlError(n, "expected a key")
        key = str(scalar(m[1], n))
        if key in out:
            raise YamlError(n, f"{key!r} is given twice")
        if m[2]:
            out[key], i = scalar(m[2], n), i + 1
        elif i + 1 < len(lines) and (lines[i + 1][0] > indent or lines[i + 1][0] == indent and lines[i + 1][1].startswith("-")):
            out[key], i = _block(lines, i + 1, lines[i + 1][0])
        else:
            out[key], i = None, i + 1
    return out, i
