"""Scanners, the pipeline of findings, gate, life cycle, debt and reports, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.severity import CATEGORIES, HOURS, PENALTY_10, PENALTY_100, category, score_10, score_100
from loomgrid.operators import debt, reports, rules
from loomgrid.operators import diff as df_
from loomgrid.operators import findings as fi
from loomgrid.plans import bindings as b
from loomgrid.sources.tables import table

GATE = fi.Gate(max_critical=0, max_major=3, max_minor=5, max_security=1, categories={"performance": ("block", 2), "style": ("warn", 0)})


def _i(spark, d):
    return b.issues(spark, d)


def _diff(spark, d):
    return df_.parse_diffs(b.fixes(spark, d))


def rule_scan(spark, d):
    return rules.scan_rules(b.lines(spark, d), cap=None).select("rule_id", "file", "line", "severity")


def security_scan(spark, d):
    """Over the lines of all suggested fixes, numbered within their fix; the issue's id takes part in the file's name."""
    i = table(spark, d, "review_issues").where("suggested_fix is not null").select(F.concat_ws("/", F.col("id").cast("string"), "file").alias("file"), F.posexplode(F.split("suggested_fix", "\n")).alias("_p", "content"))
    return rules.scan_security(i.select("file", (F.col("_p") + 1).alias("line"), "content")).select("rule_id", "file", "line", "severity")


def secret_scan(spark, d):
    i = table(spark, d, "review_issues").where("suggested_fix is not null").select("file", F.lit("unknown").alias("language"), F.col("id").cast("long").alias("line"), F.col("suggested_fix").alias("content"))
    return rules.scan_secrets(i)


def custom_rule_scan(spark, d):
    r = spark.createDataFrame([("own-lock", r"\block\b", "minor", "a lock", ["all"]), ("own-fn", r"^pub fn ", "info", "a function", ["rs"])], "id string, pattern string, severity string, message string, languages array<string>")
    return rules.scan_custom(b.lines(spark, d), r).select("rule_id", "file", "line", "severity")


def fence_lines(spark, d):
    return df_.fenced_lines(b.lines(spark, d), ["file"], "line")


def merge_priority(spark, d):
    return fi.merge_by_priority(_i(spark, d)).select("id", "source")


def known_file_filter(spark, d):
    return fi.known_files(_i(spark, d), table(spark, d, "files").select(F.col("path").alias("file"))).select("id")


def secret_fp_filter(spark, d):
    return fi.secret_false_positives(_i(spark, d), df_.added_lines(_diff(spark, d))).select("id")


def ignore_rule_filter(spark, d):
    return fi.ignore_rules(_i(spark, d), ["perf", "Consider:", " "]).select("id")


def context_line_filter(spark, d):
    return fi.context_lines(_i(spark, d), _diff(spark, d)).select("id")


def severity_threshold(spark, d):
    return fi.severity_threshold(_i(spark, d), "major").select("id", "severity")


def should_block(spark, d):
    return fi.should_block(_i(spark, d))


def exit_codes(spark, d):
    r = table(spark, d, "reviews").dropDuplicates(["id"])
    return r.select("id", fi.exit_code(F.col("gate_status"), F.col("command") == "scan", F.col("score") < 50, F.col("should_block"), F.lit("block")).alias("code"))


def repeat_filter(spark, d):
    return fi.drop_repeats(_i(spark, d)).select("id")


def fingerprints(spark, d):
    return _i(spark, d).select("id", fi.fingerprint().alias("fingerprint"))


def gate_checks(spark, d):
    return fi.gate_checks(_i(spark, d), GATE, ["review_id"])


def gate_status(spark, d):
    return fi.gate_status(fi.gate_checks(_i(spark, d), GATE, ["review_id"]), GATE, ["review_id"])


def _status(spark, d):
    return fi.status_of(_i(spark, d), b.events_log(spark, d))


def finding_status(spark, d):
    return _status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def finding_stats(spark, d):
    return fi.finding_stats(_status(spark, d))


def open_findings(spark, d):
    return fi.list_findings(_status(spark, d), "open", "major", "src/").select("id", "severity", "file")


def stale_findings(spark, d):
    """Open findings that the last review of their project does not report again."""
    f = _status(spark, d).withColumn("fingerprint", fi.fingerprint())
    return fi.stale_findings(f, f.join(b.latest_reviews(spark, d), "review_id", "left_semi")).select("id")


def quality_scores(spark, d):
    return _i(spark, d).groupBy("review_id").agg(score_10("severity").alias("score_10"), score_100("severity").alias("score_100"))


def severity_counts(spark, d):
    return _i(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


def category_counts(spark, d):
    return _i(spark, d).groupBy(category("issue_type").alias("category")).agg(F.count("*").alias("n"))


def _series(spark, d):
    n = _i(spark, d).groupBy("review_id").agg(F.count("*").alias("n"))
    r = table(spark, d, "reviews").dropDuplicates(["id"]).select(F.col("id").alias("review_id"), "created_at", (F.col("score") / 10.0).alias("quality_score"))
    return debt.halves(r.join(n, "review_id", "left").withColumn("n", F.coalesce("n", F.lit(0))), ["created_at", "review_id"])


def debt_report(spark, d):
    return debt.report(_series(spark, d))


def debt_categories(spark, d):
    s = _series(spark, d).select("review_id", "recent")
    c = _i(spark, d).groupBy("review_id", category("issue_type").alias("category")).agg(F.count("*").alias("n"))
    return debt.category_report(c.join(s, "review_id"))


def debt_hours(spark, d):
    s = _i(spark, d).groupBy("review_id").agg(*[F.count_if(F.col("severity") == x).alias(x) for x in HOURS])
    h = debt.debt_hours({x: F.col(x) for x in HOURS})
    return s.select("review_id", h.alias("hours"), debt.human_hours(h).alias("human"))


def debt_badge(spark, d):
    r = debt_report(spark, d)
    return r.select(debt.badge(F.col("score_avg"), F.col("trend"), F.lit(12.5)).alias("b")).select("b.*")


def debt_snapshots(spark, d):
    s = debt.snapshots(table(spark, d, "reviews"), table(spark, d, "review_issues"))
    return s.select("review_id", F.col("findings")["major"].alias("major"), F.coalesce(F.col("categories")["security"], F.lit(0)).alias("security"), F.round("quality_score", 6).alias("quality_score"))


def debt_retained(spark, d):
    s = table(spark, d, "reviews").dropDuplicates(["id"])
    return debt.since(debt.retained(s, F.lit("2025-10-01").cast("timestamp")), "2025-08-01", "main").select("id")


def trend_points(spark, d):
    s = table(spark, d, "reviews").dropDuplicates(["id"]).select(F.col("id").alias("review_id"), "created_at", "score")
    return debt.sampled_points(s)


def compact_report(spark, d):
    return reports.compact(_i(spark, d))


def sarif_report(spark, d):
    return reports.sarif_results(_i(spark, d))


def sarif_rules(spark, d):
    return reports.sarif_rules(_i(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        rule_scan, security_scan, secret_scan, custom_rule_scan, fence_lines, merge_priority, known_file_filter, secret_fp_filter, ignore_rule_filter, context_line_filter, severity_threshold, should_block,
        exit_codes, repeat_filter, fingerprints, gate_checks, gate_status, finding_status, finding_stats, open_findings, stale_findings, quality_scores, severity_counts, category_counts, debt_report,
        debt_categories, debt_hours, debt_badge, debt_snapshots, debt_retained, trend_points, compact_report, sarif_report, sarif_rules,
    )
}


def _case(table_: dict, col: str = "severity") -> str:
    return f"case {col} " + " ".join(f"when '{k}' then {v}" for k, v in table_.items()) + " else 0 end"


_CAT = "case " + " ".join(f"when lower(trim(issue_type)) in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in CATEGORIES.items()) + " else 'other' end"
_RANK = "case severity when 'critical' then 0 when 'major' then 1 when 'minor' then 2 when 'info' then 3 end"
_I = f"with {b.ISSUES}"
_ST = f"""{_I}, {b.EVENTS}, last_ as (select finding_id, arg_max(event_type, id) as e from log group by 1),
st as (select issues.*, case e when 'auto_resolved' then 'resolved' when 'dismissed' then 'dismissed' else 'open' end as status from issues left join last_ on finding_id = issues.id)"""
_FP = "concat_ws(':', file, cast(coalesce(line, 0) as varchar), replace(lower(title), ' ', '_'))"
_REV = "rv as (select distinct on (id) * from reviews)"
_SER = f"""{_I}, {_REV}, cnt as (select review_id, count(*) as n from issues group by 1),
ser as (select rv.id as review_id, created_at, score / 10.0 as q, coalesce(n, 0) as n, row_number() over (order by created_at, rv.id) as r, count(*) over () as total from rv left join cnt on cnt.review_id = rv.id),
hv as (select *, total < 2 or r > greatest(1, total // 2) as recent from ser)"""
_TEST = " or ".join(f"list_contains(regexp_split_to_array(lower(file), '[/_\\-.]'), '{w}')" for w in ("test", "tests", "testing", "tested", "spec", "specs", "fixture", "fixtures", "mock", "mocks", "example", "examples"))
_GS = [("max_critical", 0, "severity = 'critical'", None), ("max_major", 3, "severity = 'major'", None), ("max_minor", 5, "severity = 'minor'", None), ("max_security", 1, "issue_type = 'security'", None), ("category:performance", 2, "issue_type = 'performance'", "block"), ("category:style", 0, "issue_type = 'style'", "warn")]
_CHECKS = " union all ".join(f"select review_id, '{n}' as name, cast({m} as bigint) as threshold, count(*) filter (where {c}) as actual, count(*) filter (where {c}) <= {m} as passed, {repr(a) if a else 'cast(null as varchar)'} as action from issues group by 1" for n, m, c, a in _GS)

SQL = {
    "fence_lines": rf"""with {b.LINES}, f as (select *, case when regexp_matches(content, '^\s*(?:```|~~~)') then 1 else 0 end as fe from lines),
n as (select *, sum(fe) over (partition by file order by line rows unbounded preceding) as k from f) select file, line from n where k % 2 = 1 or fe = 1""",
    "custom_rule_scan": rf"with {b.LINES} select 'own-lock' as rule_id, file, line, 'minor' as severity from lines where regexp_matches(content, '\block\b') union all select 'own-fn', file, line, 'info' from lines where language = 'rs' and regexp_matches(content, '^pub fn ')",
    "merge_priority": f"""{_I}, s as (select *, case source when 'llm' then 0 when 'rules' then 1 when 'secrets' then 2 when 'security' then 3 end as k from issues),
m as (select file, line, min(k) as k0 from s where line is not null group by 1, 2) select s.id, s.source from s left join m on m.file = s.file and m.line = s.line where k0 is null or k = k0""",
    "known_file_filter": f"{_I} select id from issues where file in (select path from files)",
    "ignore_rule_filter": f"{_I} select id from issues where not coalesce(lower(issue_type) like '%perf%', false) and not lower(title) like '%perf%' and not coalesce(lower(issue_type) like '%consider:%', false) and not lower(title) like '%consider:%'",
    "context_line_filter": f"""{_I}, {b.FIXES}, k as (select file, new_line_no as line, bool_or(line_type = 'add') as added from diff_lines where new_line_no is not null group by 1, 2)
select i.id from issues i left join k on k.file = i.file and k.line = i.line where i.line is null or added is null or added or severity in ('critical', 'major')""",
    "secret_fp_filter": f"""{_I}, {b.FIXES}, a as (select file, new_line_no as line, bool_or(regexp_matches(content, '{fi.SECRET_LITERAL}')) as lit from diff_lines where line_type = 'add' group by 1, 2)
select i.id from issues i left join a on a.file = i.file and a.line = i.line where not coalesce(issue_type = 'security' and ({' or '.join(f"lower(title) like '%{t.replace('_', '!_')}%' escape '!'" for t in fi.SECRET_TITLES)}) and lit = false, false)""",
    "severity_threshold": f"{_I} select id, severity from issues where severity in ('critical', 'major')",
    "should_block": f"{_I} select coalesce(bool_or(severity in ('critical', 'major')), false) as should_block from issues",
    "exit_codes": f"with {_REV} select id, case when lower(gate_status) in ('fail', 'failed') then 2 when command = 'scan' and score < 50 then 2 when should_block then 2 else 0 end as code from rv",
    "repeat_filter": f"{_I} select id from (select id, row_number() over (partition by file, line, title order by {_RANK}, id) as r from issues) where r = 1",
    "fingerprints": f"{_I} select id, {_FP} as fingerprint from issues",
    "gate_checks": f"{_I} {_CHECKS}",
    "gate_status": f"{_I}, c as ({_CHECKS}) select review_id, case when bool_or(not passed and not coalesce(action = 'warn', false)) then 'FAIL' else 'PASS' end as status from c group by 1",
    "finding_status": f"{_ST} select status, count(*) as n from st group by 1",
    "finding_stats": f"""{_ST} select count(*) as total, count(*) filter (where status = 'open') as n_open, count(*) filter (where status = 'resolved') as n_resolved, count(*) filter (where status = 'dismissed') as n_dismissed,
cast(round(100.0 * count(*) filter (where status = 'resolved') / count(*)) as bigint) as resolution_rate from st""",
    "open_findings": f"{_ST} select id, severity, file from st where status = 'open' and severity = 'major' and file ilike '%src/%' order by id desc limit 50",
    "stale_findings": f"""{_ST}, {b.LATEST}, f as (select *, {_FP} as fingerprint from st), g0 as (select * from f where review_id in (select review_id from latest))
select id from f where status = 'open' and project_id is not null and not exists (select 1 from g0 g where g.project_id = f.project_id and g.fingerprint = f.fingerprint)
union all select id from f where status = 'open' and project_id is null""",
    "quality_scores": f"{_I} select review_id, round(cast(greatest(0.0, 10.0 - sum({_case(PENALTY_10)})) as double), 6) as score_10, cast(floor(greatest(0.0, 100.0 - sum({_case(PENALTY_100)}))) as bigint) as score_100 from issues group by 1",
    "severity_counts": f"{_I} select severity, count(*) as n from issues group by 1",
    "category_counts": f"{_I} select {_CAT} as category, count(*) as n from issues group by 1",
    "debt_report": f"""{_SER}, a as (select count(*) as reviews, sum(n) as total, sum(case when recent then n else -n end) as change, avg(q) as av, avg(q) filter (where recent) as r, avg(q) filter (where not recent) as p from hv)
select reviews, cast(total as bigint) as total, cast(change as bigint) as change, case when change < -1 then 'improving' when change > 1 then 'worsening' else 'stable' end as trend, round(av, 6) as score_avg, round(coalesce(r, av) - coalesce(p, av), 6) as score_change from a""",
    "debt_categories": f"""{_SER}, c as (select review_id, {_CAT} as category, count(*) as n from issues group by 1, 2),
g as (select category as name, sum(case when recent then n else 0 end) as n, sum(case when recent then n else -n end) as change from c join hv using (review_id) group by 1)
""".replace("sum(case when recent then n else 0 end)", "sum(case when recent then c.n else 0 end)").replace("sum(case when recent then n else -n end) as change from c", "sum(case when recent then c.n else -c.n end) as change from c")
    + "select name, cast(n as bigint) as n, cast(change as bigint) as change, case when change < -1 then 'improving' when change > 1 then 'worsening' else 'stable' end as trend from g",
    "debt_hours": f"""{_I}, h as (select review_id, round(cast(sum({_case(HOURS)}) as double), 6) as hours from issues group by 1)
select review_id, hours, case when hours < 1 then format('~{{:.0f}}min', hours * 60) when hours < 8 then format('~{{:.1f}}h', hours) else format('~{{:.1f}}d', hours / 8) end as human from h""",
    "debt_snapshots": f"""{_I}, {_REV} select rv.id as review_id, count(*) filter (where severity = 'major') as major, count(*) filter (where {_CAT} = 'security') as security, round(any_value(rv.score) / 10.0, 6) as quality_score from rv left join issues on issues.review_id = rv.id group by 1""",
    "debt_retained": f"with {_REV} select id from rv where created_at >= timestamp '2025-10-01' - interval 90 days and created_at >= timestamp '2025-08-01' and branch = 'main'",
    "trend_points": f"""with {_REV}, o as (select id as review_id, created_at, score, row_number() over (order by created_at, id) as r, count(*) over () as n from rv)
select review_id, created_at, score from o where (r - 1) % greatest(1, cast(ceil(n / 40.0) as bigint)) = 0 or r = n""",
    "compact_report": f"{_I} select '[' || upper(severity) || '] ' || file || coalesce(':' || line, '') || ': ' || title as text from issues",
    "sarif_report": f"{_I} select coalesce(issue_type, 'general') as rule_id, case severity when 'critical' then 'error' when 'major' then 'error' when 'minor' then 'warning' else 'note' end as level, concat_ws(chr(10) || chr(10), title, nullif(body, '')) as message, file as uri, line as start_line from issues",
    "sarif_rules": f"{_I} select coalesce(issue_type, 'general') as rule_id, min(title) as name from issues group by 1",
}
_SECRET = " union all ".join(f"select {k} as o, '{i}' as rule_id, '{s}' as severity, '{p}' as p" for k, (i, s, p) in enumerate(rules.SECRETS))
SQL["secret_scan"] = f"""with r as ({_SECRET}), f as (select file, cast(id as bigint) as line, suggested_fix as content from review_issues where suggested_fix is not null and not ({_TEST})),
h as (select file, line, content, o, rule_id, severity, p, row_number() over (partition by line order by o) as k from f, r where regexp_matches(content, p))
select rule_id, file, line, severity, substr(regexp_extract(content, p, 0), 1, 4) || '****' || right(regexp_extract(content, p, 0), 4) as masked from h where k = 1"""

_Q = lambda p: p.replace("'", "''")


def _loud(rule_id: str) -> str:
    return "".join(f" and not regexp_matches(content, '{_Q(rules.QUIET[n])}')" for n in rules.SILENCED_BY.get(rule_id, ()))


SQL["rule_scan"] = f"with {b.LINES} " + " union ".join(
    f"select '{r.id}' as rule_id, file, line, '{r.severity}' as severity from lines where regexp_matches(content, '{_Q(r.pattern)}')"
    + ("" if "all" in r.languages else f" and language in ({', '.join(repr(x) for x in r.languages)})")
    + _loud(r.id)
    for r in rules.RULES
)
SQL["security_scan"] = f"""with f as (select id || '/' || file as file, string_split(suggested_fix, chr(10)) as parts from review_issues where suggested_fix is not null),
lines as (select file, cast(generate_subscripts(parts, 1) as int) as line, unnest(parts) as content from f), src as (select * from lines where not ({_TEST})) """ + " union all ".join(
    f"select '{i}' as rule_id, file, line, '{sev}' as severity from src where regexp_matches(content, '{_Q(p)}'){_loud(i)}" for i, _, sev, p in rules.SECURITY
)

SQL["debt_badge"] = f"""with report as ({SQL['debt_report']}) select 1 as "schemaVersion", 'code quality' as label,
format('{{:.1f}}/10', score_avg) || ' · debt ~1.6d' || case trend when 'improving' then ' ▼' when 'worsening' then ' ▲' else '' end as message,
case when score_avg >= 8 then 'green' when score_avg >= 5 then 'yellow' else 'red' end as color from report"""
