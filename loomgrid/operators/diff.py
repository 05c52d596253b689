"""Unified diffs: from text to typed lines, and what is computed on them.

A diff is one row (diff_id, text).  Its state machine runs over one text at a
time in Arrow batches, so diffs spread over tasks; everything after it is
relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.paths import language

_OLD, _NEW = re.compile(r"^---\s+(?:a/)?(.*)"), re.compile(r"^\+\+\+\s+(?:b/)?(.*)")
_HUNK = re.compile(r"^@@\s-(\d+)(?:,(\d+))?\s\+(\d+)(?:,(\d+))?\s@@\s?(.*)")
_BINARY = re.compile(r"^(?:Binary files|Binary file|GIT binary patch)")
LINES = "diff_id long, file_seq int, old_path string, new_path string, is_new boolean, is_deleted boolean, is_binary boolean, hunk_seq int, old_start int, old_count int, new_start int, new_count int, line_seq int, line_type string, content string, old_line_no int, new_line_no int"
_KINDS = {"+": "add", "-": "remove", " ": "context"}


def _lines(text: str | None) -> list[str]:
    """Lines of a text, which end at newlines alone; other separators are content. A carriage return before the newline goes."""
    lines = (text or "").split("\n")
    return [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]


def parse(text: str | None) -> list[dict]:
    """Files of a diff: paths, flags and hunks of (kind, content, old number, new number).

    Inside a hunk a line counts by the hunk's announced lengths, so a removed line
    that looks like a file header stays a removed line while the hunk is not full.
    """
    files: list[dict] = []
    file = hunk = None
    for line in _lines(text):
        left = hunk is not None and (hunk["left_old"] > 0 or hunk["left_new"] > 0)
        if not left and (m := _OLD.match(line)):
            path = m[1].rstrip("\t")
            file = {"old": None if path == "/dev/null" else path, "new": None, "is_new": path == "/dev/null", "is_deleted": False, "binary": False, "hunks": []}
            files.append(file)
            hunk = None
        elif file is None:
            continue
        elif not left and (m := _NEW.match(line)):
            path = m[1].rstrip("\t")
            file["new"], file["is_deleted"] = (None, True) if path == "/dev/null" else (path, False)
        elif not left and _BINARY.match(line):
            file["binary"] = True
        elif m := _HUNK.match(line):
            a, b, c, d = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            hunk = {"old_start": a, "old_count": b, "new_start": c, "new_count": d, "left_old": b, "left_new": d, "old": a, "new": c, "lines": []}
            file["hunks"].append(hunk)
        elif hunk is not None and line[:1] in _KINDS:
            kind = _KINDS[line[0]]
            old = new = None
            if kind != "add":
                old, hunk["old"], hunk["left_old"] = hunk["old"] or None, hunk["old"] + 1, hunk["left_old"] - 1
            if kind != "remove":
                new, hunk["new"], hunk["left_new"] = hunk["new"] or None, hunk["new"] + 1, hunk["left_new"] - 1
            hunk["lines"].append((kind, line[1:], old, new))
    return files


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """All lines of all diffs, flattened; files without lines give one row without a line.  Null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in LINES.split(", ")]
        for b in batches:
            rows = []
            for i, t in zip(b["diff_id"], b["text"], strict=True):
                for fs, f in enumerate(parse(t)):
                    head = (i, fs, f["old"], f["new"], f["is_new"], f["is_deleted"], f["binary"])
                    got = [(*head, hs, h["old_start"], h["old_count"], h["new_start"], h["new_count"], k, *x) for hs, h in enumerate(f["hunks"]) for k, x in enumerate(h["lines"])]
                    rows += got or [(*head, *[None] * 10)]
            out = pd.DataFrame(rows, columns=cols)
            yield out.astype({c: "Int32" for c in ("hunk_seq", "old_start", "old_count", "new_start", "new_count", "line_seq", "old_line_no", "new_line_no")})

    d = diffs.select(F.col("diff_id").cast("long").alias("diff_id"), "text").mapInPandas(run, LINES)
    path = F.coalesce("new_path", "old_path")
    return d.withColumn("file", F.coalesce(path, F.lit("unknown"))).withColumn("language", language(F.coalesce(path, F.lit("unknown"))))


def number_lines(lines: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Line numbers of raw hunk lines by running counts: input has old_start, new_start and line_type, ordered by ``pos`` within ``key``."""
    w = W.partitionBy(*key).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    old, new = F.col("line_type") != "add", F.col("line_type") != "remove"
    return lines.withColumn("old_line_no", F.when(old, F.col("old_start") + F.sum(old.cast("int")).over(w) - 1)).withColumn("new_line_no", F.when(new, F.col("new_start") + F.sum(new.cast("int")).over(w) - 1))


def added_lines(lines: DataFrame) -> DataFrame:
    """(file, language, line, content) of added lines."""
    return lines.where("line_type = 'add' and new_line_no is not null").select("file", "language", F.col("new_line_no").alias("line"), "content")


def changed_files(lines: DataFrame) -> DataFrame:
    """Distinct (diff_id, file) on either side of the diff."""
    return lines.select("diff_id", F.explode(F.array("old_path", "new_path")).alias("file")).where("file is not null").distinct()


def diff_stats(lines: DataFrame) -> DataFrame:
    """(diff_id, n_files, n_changed)."""
    return lines.groupBy("diff_id").agg(F.countDistinct("file_seq").alias("n_files"), F.count_if(F.col("line_type").isin("add", "remove")).alias("n_changed"))


def fenced_lines(lines: DataFrame, key: list[str], order: str, line: str = "line") -> DataFrame:
    """(key..., line) inside Markdown fences, the fences included: the parity of the fences so far."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("content").rlike(r"^\s*(?:```|~~~)").cast("int")
    d = lines.withColumn("_f", fence).withColumn("_n", F.sum("_f").over(w))
    return d.where("_n % 2 = 1 or _f = 1").select(*key, F.col(line).alias("line"))


def file_blocks(text: str | None) -> list[tuple[str, str]]:
    """(path, raw text) of each file of a diff."""
    lines = _lines(text)
    starts = [i for i in range(len(lines) - 1) if lines[i].startswith(("--- a/", "--- /dev/null")) and lines[i + 1].startswith("+++ ")]
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=False):
        new, old = _NEW.match(lines[a + 1])[1], _OLD.match(lines[a])[1]
        out.append((old if new == "/dev/null" else new, "\n".join(lines[a:b])))
    return out


def label(dirs: list[str]) -> str:
    d = sorted(set(dirs))
    return f"{d[0]}/*" if len(d) == 1 else ", ".join(d) if len(d) <= 3 else f"{len(d)} dirs"


def chunk(text: str | None, max_size: int) -> list[tuple[int, int, str, int, str]]:
    """(index, total, label, files, text) of a diff's chunks: whole files packed in order up to max_size bytes; a larger file stands alone."""
    blocks = file_blocks(text)
    if not blocks:
        return [(0, 1, "empty", 0, text or "")]
    groups: list[list[tuple[str, str]]] = [[]]
    size = 0
    for p, t in blocks:
        n = len(t.encode())
        if groups[-1] and size + n > max_size:
            groups.append([])
            size = 0
        groups[-1].append((p, t))
        size += n
    return [(i, len(groups), label([p.split("/")[0] for p, _ in g]), len(g), "\n".join(t for _, t in g)) for i, g in enumerate(groups)]


def chunk_diffs(diffs: DataFrame, max_size: int) -> DataFrame:
    """(diff_id, index, total, label, n_files, text) of all diffs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *c) for i, t in zip(b["diff_id"], b["text"], strict=True) for c in chunk(t, max_size)], columns=["diff_id", "index", "total", "label", "n_files", "text"])

    return diffs.select(F.col("diff_id").cast("long").alias("diff_id"), "text").mapInPandas(run, "diff_id long, index int, total int, label string, n_files int, text string")
