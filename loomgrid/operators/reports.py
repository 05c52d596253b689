"""Findings and reports as documents; everything row-wise stays a column expression."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.severity import normal, rank

LEVELS = {"critical": "error", "major": "error", "minor": "warning", "info": "note"}


def compact_line() -> Column:
    """``[SEV] file:line: title``, without the line where there is none."""
    place = F.concat(F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    return F.concat(F.lit("["), F.upper(normal("severity")), F.lit("] "), place, F.lit(": "), F.col("title"))


def compact(issues: DataFrame) -> DataFrame:
    return issues.orderBy(rank("severity"), "file", "line", "title").select(compact_line().alias("text"))


def sarif_results(issues: DataFrame) -> DataFrame:
    """(rule_id, level, message, uri, start_line) of SARIF results."""
    level = None
    for s, v in LEVELS.items():
        level = F.when(normal("severity") == s, v) if level is None else level.when(normal("severity") == s, v)
    return issues.select(F.coalesce("issue_type", F.lit("general")).alias("rule_id"), level.otherwise("note").alias("level"), F.concat_ws("\n\n", "title", F.when(F.col("body") != "", F.col("body"))).alias("message"), F.col("file").alias("uri"), F.col("line").alias("start_line"))


def sarif_rules(issues: DataFrame) -> DataFrame:
    """(rule_id, name): one rule for each type, named by its smallest title."""
    return issues.groupBy(F.coalesce("issue_type", F.lit("general")).alias("rule_id")).agg(F.min("title").alias("name"))


def sarif_json(issues: DataFrame, tool: str = "loomgrid", version: str = "0.1.0") -> DataFrame:
    """One row a finding: the SARIF result as JSON text; a writer wraps the rows of a run with ``sarif_document``."""
    r = sarif_results(issues)
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine")))
    place = F.array(F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return r.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def sarif_document(results: list[str], rules: list[tuple[str, str]], tool: str = "loomgrid", version: str = "0.1.0") -> str:
    """The SARIF 2.1.0 document of one run's results, for the findings of a single review."""
    driver = {"name": tool, "version": version, "rules": [{"id": i, "name": n} for i, n in rules]}
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": [json.loads(r) for r in results]}]})


def issues_json(issues: DataFrame) -> DataFrame:
    """Findings as JSON lines, nulls left out."""
    return issues.select(F.to_json(F.struct(*issues.columns)).alias("json"))


def pretty(issues: DataFrame, by: str = "review_id") -> DataFrame:
    """(by, file, text): the findings of a file as a block, worst first, then by line; a finding without a line comes first of its severity."""
    line = F.format_string("  %s %s  %s", F.upper("severity"), F.coalesce(F.concat(F.lit("L"), F.col("line").cast("string")), F.lit("-")), F.col("title"))
    d = issues.select(by, "file", F.struct(rank("severity").alias("r"), F.coalesce("line", F.lit(0)).alias("l"), "id", line.alias("t")).alias("_f"))
    g = d.groupBy(by, "file").agg(F.array_sort(F.collect_list("_f")).alias("_f"), F.count("*").alias("_n"))
    return g.select(by, "file", F.concat(F.col("file"), F.lit(" ("), F.col("_n").cast("string"), F.lit(")\n"), F.array_join(F.transform("_f", lambda x: x["t"]), "\n")).alias("text"))


def marked(document: DataFrame, tool: str = "loomgrid") -> DataFrame:
    """JSON lines with the name of the tool and whether the line holds findings."""
    return document.withColumn("json", F.concat(F.lit(f'{{"generated_by":"{tool}",'), F.expr("substring(json, 2)")))


def trend_graph(points: list[tuple[str, float]], height: int = 8) -> str:
    """A text graph of at most 40 points of a score from 0 to 10."""
    rows = []
    for level in range(height, 0, -1):
        cut = 10 * (level - 0.5) / height
        rows.append(f"{10 * level / height:4.1f} |" + "".join("*" if v >= cut else " " for _, v in points))
    return "\n".join([*rows, "     +" + "-" * len(points)])


def progress_event(kind: str, **fields) -> str:
    """One newline-delimited JSON event."""
    return json.dumps({"event": kind, **fields}, sort_keys=True)
