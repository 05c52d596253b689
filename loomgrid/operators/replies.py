"""Reviewer replies: JSON with fences, stray summaries, bad escapes and cut ends, to typed findings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.severity import SEVERITIES

PREVIEW_BYTES = 512
SCHEMA = "reply_id long, file string, line int, severity string, issue_type string, title string, body string, suggested_fix string, summary string, error string"


def split_summary(raw: str) -> tuple[str, str]:
    """(json part, summary): a reply may carry its summary between ``|||`` marks, before or after the JSON."""
    parts = [p.strip() for p in raw.split("|||")]
    if len(parts) == 1:
        return raw.strip(), ""
    body = next((p for p in parts if re.match(r"(?:```\w*\s*)?[\[{]", p)), parts[0])
    return body, " ".join(p for p in parts if p and p is not body)


def strip_fences(s: str) -> str:
    m = re.match(r"\s*```[\w-]*\s*\n?(.*?)(?:\n?\s*```\s*)?$", s, re.S)
    return m[1] if m else s


def fix_strings(s: str) -> str:
    """Escape what JSON forbids inside strings: control characters and backslashes that escape nothing."""
    out, inside, i = [], False, 0
    while i < len(s):
        c = s[i]
        if not inside:
            inside = c == '"'
            out.append(c)
        elif c == "\\":
            nxt = s[i + 1 : i + 2]
            ok = nxt and nxt in '"\\/bfnrt' or re.match(r"u[0-9a-fA-F]{4}", s[i + 1 : i + 6])
            out.append("\\" + nxt if ok else "\\\\" + nxt)
            i += 1
        elif c == '"':
            inside = False
            out.append(c)
        else:
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c) or (c if ord(c) >= 32 else f"\\u{ord(c):04x}"))
        i += 1
    return "".join(out)


def close_cut(s: str) -> str:
    """Close what a cut left open; a dangling key or comma goes."""
    stack, inside, esc = [], False, False
    for c in s:
        if inside:
            esc, inside = (False, True) if esc else (c == "\\", c != '"')
        elif c == '"':
            inside = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and stack:
            stack.pop()
    t = (s[:-1] if esc else s) + ('"' if inside else "")
    t = re.sub(r',?\s*"(?:\\.|[^"\\])*"\s*:\s*$', "", t.rstrip()) if not inside else t
    return re.sub(r"[,:]\s*$", "", t.rstrip()) + "".join(reversed(stack))


def whole_objects(s: str) -> list[str]:
    """The complete top-level objects of a cut array."""
    out, depth, start, inside, esc = [], 0, -1, False, False
    for i, c in enumerate(s):
        if inside:
            esc, inside = (False, True) if esc else (c == "\\", c != '"')
        elif c == '"':
            inside = True
        elif c == "{":
            start, depth = (i, 1) if depth == 0 else (start, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(s[start : i + 1])
    return out


def preview(raw: str, most: int = PREVIEW_BYTES) -> str:
    """Blanks collapsed, cut at a whole character within the bound of bytes."""
    t = " ".join(raw.split())
    return t if len(t.encode()) <= most else t.encode()[:most].decode(errors="ignore") + "..."


def _load(text: str) -> list | dict | None:
    try:
        return json.loads(text)
    except ValueError:
        return None


def parse_reply(raw: str | None) -> tuple[list[dict], str, str | None]:
    """(findings, summary, error) of one reply; an error says what it looked like."""
    if not raw or not raw.strip():
        return [], "", "empty reply"
    body, summary = split_summary(raw)
    body = strip_fences(body).strip()
    if body[:1] not in "[{":
        return [], summary, f"no JSON (length={len(raw.encode())}): {preview(raw)}"
    got = None
    for attempt in (body, fix_strings(body), close_cut(fix_strings(body))):
        got = _load(attempt)
        if got is not None:
            break
    if got is None:
        got = [x for o in whole_objects(fix_strings(body)) if isinstance(x := _load(o), dict)]
        if not got:
            return [], summary, f"malformed JSON: {preview(raw)}"
    if isinstance(got, dict):
        summary = summary or str(got.get("summary") or "")
        got = got.get("issues", got.get("findings", [got] if "title" in got else []))
    out = []
    for x in got if isinstance(got, list) else []:
        if isinstance(x, dict) and x.get("file") and x.get("title"):
            sev = str(x.get("severity") or "info").lower()
            line = x.get("line")
            out.append({"file": str(x["file"]), "line": line if isinstance(line, int) and not isinstance(line, bool) else None, "severity": sev if sev in SEVERITIES else "info", "issue_type": x.get("issue_type", x.get("type")), "title": str(x["title"]), "body": str(x.get("body") or ""), "suggested_fix": x.get("suggested_fix")})
    return out, summary, None


def parse_replies(replies: DataFrame) -> DataFrame:
    """Findings of all replies (reply_id, text); a reply without findings gives one row with its summary or error."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found, summary, error = parse_reply(t)
                for x in found or [{}]:
                    text = {k: v if v is None or k == "line" else str(v) for k, v in x.items()}
                    rows.append({"reply_id": i, **text, "summary": summary, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return replies.select(F.col("reply_id").cast("long").alias("reply_id"), "text").mapInArrow(run, SCHEMA)
