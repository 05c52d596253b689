"""Context for a review: what changed code refers to, who calls it, and how much of that fits a budget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.names import bare_name
from loomgrid.operators.graph import symbol_callers

PRIORITY = {"function": 0, "type": 1, "test": 2, "caller": 3}
# Most lines of an entry by priority, default budget, span taken for a definition.
LINE_CAPS, BUDGET, SPAN = [50, 50, 30, 4], 5000, 50


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    depth: int = 1
    impact_depth: int = 2
    types: bool = True
    tests: bool = True
    callers: bool = True
    budget: int = BUDGET


def tokens(text: str | None) -> int:
    """A quarter of the bytes, one at least; none for an empty text."""
    n = len((text or "").encode())
    return max(1, n // 4) if n else 0


def resolve(refs: DataFrame, symbols: DataFrame, per_name: int = 5) -> DataFrame:
    """(ref_file, name, file, line_from, line_to, kind): symbols that references name, at most ``per_name`` each, outside the referring file."""
    r = refs.select(F.col("file").alias("ref_file"), bare_name("name").alias("name"), F.when(F.col("kind") == "type", "type").otherwise("function").alias("kind")).where(F.length("name") >= 2).distinct()
    j = r.join(symbols.select("name", "file", "line"), "name").where("file != ref_file").distinct()
    w = W.partitionBy("ref_file", "name", "kind").orderBy("file", "line")
    d = j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_name)
    return d.select("ref_file", "name", "kind", "file", F.col("line").alias("line_from"), (F.col("line") + SPAN).alias("line_to"))


def callers(definitions: DataFrame, calls: DataFrame, per_name: int = 20) -> DataFrame:
    """(ref_file, name, kind, file, line_from, line_to): callers of definitions in other files, one line around each call."""
    c = symbol_callers(calls, definitions, per_name)
    d = definitions.select(F.col("file").alias("ref_file"), "name").distinct().join(c, "name").where("file != ref_file")
    return d.select("ref_file", "name", F.lit("caller").alias("kind"), "file", F.greatest(F.col("line") - 1, F.lit(1)).alias("line_from"), (F.col("line") + 1).alias("line_to"))


def drop_overlaps(entries: DataFrame, review: str = "ref_file") -> DataFrame:
    """Keep an entry unless its lines overlap an earlier kept one of the same review and file.

    In order of lines, then of all other columns, an entry overlaps an earlier kept
    one exactly when it starts at or before the furthest kept end; entries stream by
    in that order, and only the end is held.  An entry without a first line is kept.
    """
    key = [review, "file"]
    rest = [c for c in entries.columns if c not in (*key, "line_from", "line_to")]
    d = entries.repartition(*key).sortWithinPartitions(*key, "line_from", "line_to", *rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, end = object(), -1
        for g in batches:
            keep = []
            for r, f, a, b in zip(g[review], g["file"], g["line_from"], g["line_to"], strict=True):
                if (r, f) != now:
                    now, end = (r, f), -1
                fresh = not a <= end
                keep.append(fresh)
                end = b if fresh and a == a and a is not None else end
            yield g[keep]

    return d.mapInPandas(run, entries.schema)


def signature_only(content: str) -> str:
    """Up to four lines, ending at the first opening brace."""
    out = []
    for line in content.split("\n")[:4]:
        out.append(line)
        if "{" in line:
            break
    return "\n".join(out)


def assemble(entries: DataFrame, budget: int = BUDGET, review: str = "review") -> DataFrame:
    """(review, seq, taken, used, budget_hit) added to entries (review, seq, kind, content): the greedy choice under a token budget.

    By priority, then in order: an entry is taken whole, or by its signature, or
    skipped; smaller ones after it may still fit, so no running sum says it.
    """
    kind_of = dict(entries.dtypes)[review]
    schema = f"{review} {kind_of}, seq int, kind string, taken string, used int, budget_hit boolean"
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("kind")), F.lit(9))
    d = entries.select(review, "seq", "kind", "content", rank.alias("_p")).repartition(review).sortWithinPartitions(review, "_p", "seq", "kind", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A review's taken entries wait for its end, which tells whether the budget was hit; they fit the budget.
        now, used, hit, rows = object(), 0, False, []
        columns = [review, "seq", "kind", "taken", "used", "budget_hit"]
        for g in batches:
            out = []
            for r, s, k, p, c in zip(g[review], g["seq"], g["kind"], g["_p"], g["content"], strict=True):
                if r != now:
                    out += [[*x, hit] for x in rows]
                    now, used, hit, rows = r, 0, False, []
                lines = (c or "").split("\n")
                cap = LINE_CAPS[int(p)] if p < 4 else 4
                text = "\n".join(lines[:cap]) + ("\n..." if len(lines) > cap else "")
                for t in (text, signature_only(c or "")):
                    if (n := tokens(t)) and used + n <= budget:
                        used += n
                        rows.append([r, s, k, t, n])
                        break
                else:
                    hit = hit or bool(c)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([[*x, hit] for x in rows], columns=columns)

    return d.mapInPandas(run, schema)


def impact_summary(impact: DataFrame, top: int = 5) -> DataFrame:
    """(via, files, more): the first files of each name's impact, and how many are left."""
    f = impact.groupBy("via", "file").agg(F.min(F.struct("depth", "line")).alias("_at"))
    w = W.partitionBy("via").orderBy("_at", "file")
    r = f.withColumn("_r", F.row_number().over(w))
    g = r.groupBy("via").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "file")))), lambda x: x["file"]).alias("files"), F.count("*").alias("_n"))
    return g.select("via", "files", F.greatest(F.col("_n") - top, F.lit(0)).alias("more"))


def language_guidance(languages: DataFrame, guidance: dict[str, str]) -> DataFrame:
    """(language, text) of the languages that occur and have guidance, sorted."""
    g = languages.sparkSession.createDataFrame(sorted(guidance.items()), "language string, text string")
    return languages.select("language").distinct().join(g, "language").orderBy("language")


def section(rows: list[dict]) -> str:
    """Findings as a text section."""
    return "\n".join(f"- [{r['severity'].upper()}] {r['file']}:{r['line']}: {r['title']}" for r in rows)


def scan_query(paths: list[str], most: int = 10) -> str:
    """The search text of a scan: its first files, as words."""
    return " ".join(w for p in paths[:most] for w in re.findall(r"\w+", p))
