"""The pipeline of findings: merge by priority, filters, gate, and life cycle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.paths import is_markdown
from loomgrid.functions.severity import at_least, normal, rank
from loomgrid.operators.ordering import numbered
from loomgrid.operators.rules import RULES

#: Order of the sources: an earlier one silences a later one on the same line.
SOURCES = ["llm", "rules", "secrets", "security", "unused_import", "dead_code", "breaking"]
# What a title about a written-out credential says.
SECRET_TITLES = ["hardcoded password", "hardcoded secret", "hardcoded credential", "hardcoded token", "hardcoded api key", "hardcoded api_key"]
#: A written-out credential, as the rule for it sees one.
SECRET_LITERAL = next(r.pattern for r in RULES if r.id == "sec-hardcoded-secret")


def source_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for i, s in enumerate(SOURCES):
        out = F.when(c == s, i) if out is None else out.when(c == s, i)
    return out.otherwise(len(SOURCES))


def merge_by_priority(issues: DataFrame, source: str = "source") -> DataFrame:
    """Drop a finding where an earlier source has one on the same file and line.

    Duplicates within a source stay, and a finding without a line neither
    silences nor is silenced.  The earliest source of a place is a pre-aggregated
    minimum, so a file with very many findings is no single window.
    """
    d = issues.withColumn("_s", source_rank(source))
    first = d.where("line is not null").groupBy("file", "line").agg(F.min("_s").alias("_first"))
    j = d.join(first, ["file", "line"], "left")
    return j.where("_first is null or _s = _first").select(*issues.columns)


def known_files(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Keep issues on known files; where no files are known, keep all."""
    f = files.select("file").distinct()
    n = f.agg(F.count("*").alias("_n"))
    hit = issues.join(f.withColumn("_in", F.lit(True)), "file", "left").join(F.broadcast(n))
    return hit.where("_in or _n = 0").select(*issues.columns)


def secret_false_positives(issues: DataFrame, added: DataFrame, issue_type: str = "issue_type") -> DataFrame:
    """Drop security issues about written-out credentials whose added line holds no such literal; issues on other lines stay."""
    low, about = F.lower("title"), F.lit(False)
    for t in SECRET_TITLES:
        about = about | low.contains(t)
    a = added.groupBy("file", "line").agg(F.max(F.col("content").rlike(SECRET_LITERAL)).alias("_lit"))
    j = issues.join(a, ["file", "line"], "left")
    drop = (F.col(issue_type) == "security") & about & (F.col("_lit") == F.lit(False))
    return j.where(~F.coalesce(drop, F.lit(False))).select(*issues.columns)


def outside_fences(issues: DataFrame, fenced: DataFrame) -> DataFrame:
    """Drop issues on Markdown lines inside code fences; ``fenced`` has file and line."""
    f = fenced.where(is_markdown("file")).select("file", "line").distinct()
    return issues.join(f, ["file", "line"], "left_anti").select(*issues.columns)


def ignore_rules(issues: DataFrame, patterns: list[str], issue_type: str = "issue_type") -> DataFrame:
    """Drop issues whose type or title contains a pattern, without regard to case; blank patterns are none."""
    hit = F.lit(False)
    for p in (x.strip().lower() for x in patterns):
        if p:
            hit = hit | F.coalesce(F.lower(issue_type).contains(p), F.lit(False)) | F.coalesce(F.lower("title").contains(p), F.lit(False))
    return issues.where(~hit)


def context_lines(issues: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """On unchanged lines of the diff keep only major and worse; issues on added lines or outside the diff stay."""
    k = diff_lines.where("new_line_no is not null").groupBy("file", F.col("new_line_no").alias("line")).agg(F.max(F.col("line_type") == "add").alias("_added"))
    j = issues.join(k, ["file", "line"], "left")
    return j.where(F.col("line").isNull() | F.col("_added").isNull() | F.col("_added") | at_least("severity", "major")).select(*issues.columns)


def review_pipeline(issues: DataFrame, files: DataFrame, diff_lines: DataFrame, fenced: DataFrame | None = None, ignore: list[str] | None = None, llm_failed: bool = False) -> DataFrame:
    """The findings of a review after all filters, from those of all sources.

    Sources are merged by priority, then go findings on unknown files, about
    credentials that are none, in fences, by ignore rules, and on unchanged lines.
    Where the model failed, only rule-based findings are merged, and the filters that
    guard against its inventions (files, credentials, unchanged lines) are left out.
    """
    from loomgrid.operators.diff import added_lines

    d = merge_by_priority(issues.where(F.col("source") != SOURCES[0]) if llm_failed else issues)
    if not llm_failed:
        d = secret_false_positives(known_files(d, files), added_lines(diff_lines))
    if fenced is not None:
        d = outside_fences(d, fenced)
    d = ignore_rules(d, ignore or [])
    return d if llm_failed else context_lines(d, diff_lines)


def token_usage(reviews: DataFrame, by: list[str]) -> DataFrame:
    """(by..., reviews, input_tokens, output_tokens, cost_usd) of all reviews; a review stored twice counts once, missing numbers as 0."""
    one = reviews.groupBy("id").agg(F.max(F.struct(*by, "input_tokens", "output_tokens", "cost_usd")).alias("_r")).select("_r.*")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return one.groupBy(*by).agg(F.count("*").alias("reviews"), total("input_tokens"), total("output_tokens"), total("cost_usd"))


def severity_threshold(issues: DataFrame, least: str) -> DataFrame:
    return issues.where(at_least("severity", least))


def should_block(issues: DataFrame, least: str = "major") -> DataFrame:
    """One row (should_block): whether any issue is the given severity or worse."""
    return issues.agg(F.coalesce(F.bool_or(at_least("severity", least)), F.lit(False)).alias("should_block"))


def exit_code(gate: Column, ci: Column, any_left: Column, block: Column, mode: Column) -> Column:
    """2 for a failed gate, for anything left in continuous integration, and for a block in blocking mode; else 0."""
    return F.when(F.lower(gate).isin("fail", "failed"), 2).when(ci & any_left, 2).when(block & (mode == "block"), 2).otherwise(0)


def drop_repeats(issues: DataFrame) -> DataFrame:
    """One of the issues with the same file, line and title: the worst, then the smallest id."""
    w = W.partitionBy("file", "line", "title").orderBy(rank("severity"), "id")
    return issues.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fingerprint(file: str = "file", line: str = "line", title: str = "title") -> Column:
    """``file:line:title`` with line 0 where there is none, the title in lower case and blanks as underscores."""
    return F.concat_ws(":", F.col(file), F.coalesce(F.col(line), F.lit(0)).cast("string"), F.replace(F.lower(title), F.lit(" "), F.lit("_")))


@dataclass
class Gate:
    enabled: bool = True
    max_critical: int | None = 0
    max_major: int | None = None
    max_minor: int | None = None
    max_security: int | None = 0
    #: category -> (action, most findings or None)
    categories: dict[str, tuple[str, int | None]] = field(default_factory=dict)


def gate_checks(issues: DataFrame, gate: Gate, by: list[str], issue_type: str = "issue_type") -> DataFrame:
    """(by..., name, threshold, actual, passed, action): one row for each check and group, from one aggregation."""
    s, t = normal("severity"), F.lower(issue_type)
    checks = [("max_critical", gate.max_critical, F.count_if(s == "critical"), None), ("max_major", gate.max_major, F.count_if(s == "major"), None), ("max_minor", gate.max_minor, F.count_if(s == "minor"), None), ("max_security", gate.max_security, F.count_if(t == "security"), None)]
    checks += [(f"category:{c}", most, F.count_if(t == c.lower()), a) for c, (a, most) in sorted(gate.categories.items()) if a != "ignore" and most is not None]
    checks = [c for c in checks if c[1] is not None]
    g = issues.groupBy(*by).agg(*[n.alias(f"_c{i}") for i, (_, _, n, _) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).cast("long").alias("threshold"), F.col(f"_c{i}").alias("actual"), (F.col(f"_c{i}") <= m).alias("passed"), F.lit(a).cast("string").alias("action")) for i, (n, m, _, a) in enumerate(checks)])
    return g.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def gate_status(checks: DataFrame, gate: Gate, by: list[str]) -> DataFrame:
    """(by..., status): FAIL where a check failed whose action is not to warn; a disabled gate passes."""
    bad = F.bool_or(~F.col("passed") & ~F.coalesce(F.col("action") == "warn", F.lit(False)))
    return checks.groupBy(*by).agg(F.when(bad & F.lit(gate.enabled), "FAIL").otherwise("PASS").alias("status"))


# --- life cycle: an append-only log of events ------------------------------


def status_of(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings with their status: the latest event (by id) decides; without one a finding is open."""
    last = events.groupBy("finding_id").agg(F.max_by("event_type", "id").alias("_e"))
    j = findings.join(last.withColumnRenamed("finding_id", "id"), "id", "left")
    state = F.when(F.col("_e") == "auto_resolved", "resolved").when(F.col("_e") == "dismissed", "dismissed").otherwise("open")
    return j.select(*[c for c in findings.columns if c != "status"], state.alias("status"))


def stale_findings(open_findings: DataFrame, current: DataFrame) -> DataFrame:
    """Open findings whose fingerprint is not among the current ones of their project; findings without a fingerprint never go stale."""
    c = current.select("project_id", "fingerprint").where("fingerprint is not null").distinct()
    return open_findings.where("fingerprint is not null and status = 'open'").join(c, ["project_id", "fingerprint"], "left_anti")


def resolution_events(stale: DataFrame, first_id: int, at: Column) -> DataFrame:
    """auto_resolved events of stale findings, numbered from first_id by finding."""
    d = numbered(stale, ["id"], "_row")
    return d.select((F.col("_row") + first_id - 1).cast("long").alias("id"), F.col("id").alias("finding_id"), F.lit("auto_resolved").alias("event_type"), F.lit(None).cast("string").alias("note"), at.alias("created_at"))


def change_event(findings: DataFrame, finding_id: int, event: str, event_id: int, note: str | None, at: Column) -> DataFrame:
    """The event that dismisses or reopens a finding: none for an unknown one, or to reopen an open one."""
    f = findings.where(F.col("id") == finding_id)
    if event == "reopened":
        f = f.where("status != 'open'")
    return f.select(F.lit(event_id).cast("long").alias("id"), F.col("id").alias("finding_id"), F.lit(event).alias("event_type"), F.lit(note).cast("string").alias("note"), at.alias("created_at"))


def save_review(review: DataFrame, issues: DataFrame, review_id: int, first_finding: int, first_event: int, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that a finished review appends: the review, its findings, all open, and an opened event for each.

    ``review`` is one row of attributes; findings are numbered by file, line and title.
    """
    r = review.withColumn("id", F.lit(review_id).cast("long")).withColumn("created_at", at)
    n = numbered(issues, ["file", "line", "title"], "_row")
    f = n.select((F.col("_row") + first_finding - 1).cast("long").alias("id"), F.lit(review_id).cast("long").alias("review_id"), "file", "line", normal("severity").alias("severity"), "issue_type", "title", "body", F.lit("open").alias("status"), fingerprint().alias("fingerprint"), at.alias("created_at"))
    e = f.select((F.col("id") - first_finding + first_event).alias("id"), F.col("id").alias("finding_id"), F.lit("opened").alias("event_type"), F.lit(None).cast("string").alias("note"), "created_at")
    return r, f, e


def list_findings(findings: DataFrame, status: str | None = "open", severity: str | None = None, file: str | None = None, limit: int = 50) -> DataFrame:
    from loomgrid.functions.paths import contains_like

    d = findings
    if status:
        d = d.where(F.col("status") == status)
    if severity:
        d = d.where(normal("severity") == severity.lower())
    if file:
        d = d.where(contains_like("file", file))
    return d.orderBy(F.desc("id")).limit(limit)


def finding_stats(findings: DataFrame) -> DataFrame:
    """(total, open, resolved, dismissed, resolution_rate) in one row; the rate is a whole percentage."""
    a = findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("open", "n_open"), ("resolved", "n_resolved"), ("dismissed", "n_dismissed"))])
    return a.withColumn("resolution_rate", F.when(F.col("total") > 0, F.round(100.0 * F.col("n_resolved") / F.col("total"))).otherwise(0.0).cast("long"))
