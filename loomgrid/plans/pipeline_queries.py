"""The composed review pipeline, usage, life-cycle events, names and paths, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import paths
from loomgrid.functions.text import camel_parts
from loomgrid.operators import context, diff, reports
from loomgrid.operators import findings as fi
from loomgrid.operators import graph as g
from loomgrid.plans import bindings as b
from loomgrid.plans import finding_queries as fq
from loomgrid.plans import graph_queries as gq
from loomgrid.sources.tables import table

P = b.PROJECT
IGNORE = ["perf", "Consider:", " "]
ENTRY = ["*handler", "main*", "*seal*", "new"]
CONTEXT_IGNORE = ["src/v*", "**/gen/**"]
FILE = "src/"


def _reviewed(spark, d, failed):
    files = table(spark, d, "files").select(F.col("path").alias("file"))
    return fi.review_pipeline(b.issues(spark, d), files, diff.parse_diffs(b.fixes(spark, d)), diff.fenced_lines(b.lines(spark, d), ["file"], "line"), IGNORE, failed).select("id")


def review_pipeline(spark, d):
    return _reviewed(spark, d, False)


def review_fallback(spark, d):
    """The same after the model failed."""
    return _reviewed(spark, d, True)


def token_usage(spark, d):
    u = fi.token_usage(table(spark, d, "reviews"), ["provider"])
    return u.withColumn("cost_usd", F.round("cost_usd", 6))


def _a_file(spark, d):
    return b.symbols(spark, d).where(F.col("project_id") == P).agg(F.min("file")).first()[0] or ""


def dead_code_file(spark, d):
    return g.dead_code_in_file(b.symbols(spark, d), b.calls(spark, d), _a_file(spark, d), P).select("name", "kind", "file", "line")


def diff_added(spark, d):
    return diff.added_lines(diff.parse_diffs(b.fixes(spark, d))).select("file", "line", "content")


def camel_names(spark, d):
    return b.symbols(spark, d).select("id", F.array_join(camel_parts("name"), " ").alias("words"))


def entry_points(spark, d):
    return b.symbols(spark, d).where(paths.entry_point("name", ENTRY)).select("id", "name")


def context_ignored(spark, d):
    return table(spark, d, "files").where(paths.ignored("path", CONTEXT_IGNORE)).select("project_id", "path").distinct()


def dismiss_events(spark, d):
    """What dismissing the first open finding appends."""
    f = fi.status_of(b.issues(spark, d), b.events_log(spark, d))
    first = f.where("status = 'open'").agg(F.min("id")).first()[0] or 0
    return fi.change_event(f, first, "dismissed", 10**9, "known", F.lit("2025-01-01").cast("timestamp_ntz")).select("id", "finding_id", "event_type", "note")


def saved_findings(spark, d):
    """The findings of the review that holds most, as a new review would store them."""
    i = b.issues(spark, d)
    most = i.groupBy("review_id").count().orderBy(F.desc("count"), "review_id").limit(1).select("review_id")
    one = i.join(F.broadcast(most), "review_id", "left_semi")
    at = F.lit("2025-01-01").cast("timestamp_ntz")
    _, f, _ = fi.save_review(spark.range(1).select(F.lit("scan").alias("command")), one, 900, 5000, 7000, at)
    return f.select("id", "review_id", "file", "line", "severity", "title", "status")


def impact_summary(spark, d):
    s = context.impact_summary(g.impact(b.calls(spark, d), gq.NAME, P, 3))
    return s.select("via", F.array_join("files", ",").alias("files"), "more")


def pretty_report(spark, d):
    return reports.pretty(b.issues(spark, d))


QUERIES = {f.__name__: f for f in (review_pipeline, review_fallback, token_usage, dead_code_file, diff_added, camel_names, entry_points, context_ignored, dismiss_events, saved_findings, impact_summary, pretty_report)}

_ISSUES = f"with {b.ISSUES}, {b.FIXES}"
_MERGED = """s as (select *, case source when 'llm' then 0 when 'rules' then 1 when 'secrets' then 2 when 'security' then 3 end as k from {0}),
m as (select file, line, min(k) as k0 from s where line is not null group by 1, 2), merged as (select s.* from s left join m on m.file = s.file and m.line = s.line where k0 is null or k = k0)"""
_KEPT = "not coalesce(lower(issue_type) like '%perf%', false) and not coalesce(lower(title) like '%perf%', false) and not coalesce(lower(issue_type) like '%consider:%', false) and not coalesce(lower(title) like '%consider:%', false)"
_ABOUT = " or ".join("lower(title) like '%" + t.replace("_", "!_") + "%' escape '!'" for t in fi.SECRET_TITLES)
SQL = {
    "review_pipeline": f"""{_ISSUES}, {_MERGED.format('issues')},
a as (select file, new_line_no as line, bool_or(regexp_matches(content, '{fi.SECRET_LITERAL}')) as lit from diff_lines where line_type = 'add' group by 1, 2),
k as (select file, new_line_no as line, bool_or(line_type = 'add') as added from diff_lines where new_line_no is not null group by 1, 2)
select i.id from merged i left join a on a.file = i.file and a.line = i.line left join k on k.file = i.file and k.line = i.line
where i.file in (select path from files) and not coalesce(issue_type = 'security' and ({_ABOUT}) and lit = false, false) and {_KEPT} and (i.line is null or added is null or added or severity in ('critical', 'major'))""",
    "review_fallback": f"""with {b.ISSUES}, rest as (select * from issues where source <> 'llm'), {_MERGED.format('rest')} select id from merged where {_KEPT}""",
    "token_usage": """with o as (select distinct id, provider, input_tokens, output_tokens, cost_usd from reviews)
select provider, count(*) as reviews, cast(sum(coalesce(input_tokens, 0)) as bigint) as input_tokens, cast(sum(coalesce(output_tokens, 0)) as bigint) as output_tokens, round(sum(coalesce(cost_usd, 0)), 6) as cost_usd from o group by 1""",
    "dead_code_file": f"""select name, kind, file, line from symbols s where project_id = {P} and file = (select min(file) from symbols where project_id = {P}) and kind in ('function', 'method', 'procedure') and name not in ({gq._WELL})
 and not exists (select 1 from call_graph c where c.project_id = {P} and c.callee = s.name) and name not ilike 'test_%' and name not ilike '%_test'""",
    "diff_added": f"with {b.FIXES} select file, new_line_no as line, content from diff_lines where line_type = 'add' and new_line_no is not null",
    "camel_names": r"select id, regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '([^ ])([A-Z][a-z])', '\1 \2', 'g') as words from symbols",
    "entry_points": "select id, name from symbols where lower(name) like '%handler' or lower(name) like 'main%' or lower(name) like '%seal%' or lower(name) = 'new'",
    "context_ignored": "select distinct project_id, path from files where path like '%src/v%' or path like '%gen%'",
    "dismiss_events": f"{fq._ST} select cast(1000000000 as bigint) as id, min(id) as finding_id, 'dismissed' as event_type, 'known' as note from st where status = 'open' having min(id) is not null",
    "saved_findings": f"""with {b.ISSUES}, most as (select review_id from issues group by 1 order by count(*) desc, 1 limit 1),
n as (select *, row_number() over (order by file nulls first, line nulls first, title nulls first) as r from issues where review_id = (select review_id from most))
select cast(4999 + r as bigint) as id, cast(900 as bigint) as review_id, file, line, severity, title, 'open' as status from n""",
    "impact_summary": f"""with imp as ({gq._impact_sql(3)}), f as (select via, file, min(struct_pack(d := depth, l := line)) as first_at from imp group by 1, 2),
r as (select *, row_number() over (partition by via order by first_at, file) as k from f) select via, string_agg(file, ',' order by k) filter (where k <= 5) as files, greatest(count(*) - 5, 0) as more from r group by 1""",
    "pretty_report": f"""with {b.ISSUES} select review_id, file, file || ' (' || count(*) || ')' || chr(10) || string_agg('  ' || upper(severity) || ' ' || coalesce('L' || line, '-') || '  ' || title, chr(10)
 order by {fq._RANK}, coalesce(line, 0), id) as text from issues group by 1, 2""",
}
