"""Relations of the engine as views of the given tables, in Spark and in SQL.

The tables hold no typed edges, diff lines or source files as such; these views
derive them by fixed rules over whole tables, so that every operator has an
input and every query an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.names import bare_name
from loomgrid.sources.tables import spread, table

PROJECT = 1


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "call_graph")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Every call as a typed edge, its kind by id; imports name the bare symbol, routes carry a method."""
    c = calls(spark, d).where("callee is not null")
    k = F.pmod("id", F.lit(4))
    kind = F.when(k == 0, "IMPORTS").when(k == 1, "IMPLEMENTS").when(k == 2, "INHERITS").otherwise("ROUTE")
    target = F.when(k == 0, bare_name("callee")).when(k == 3, F.concat(F.lit("GET /"), F.col("callee"))).otherwise(F.col("callee"))
    return c.select("id", F.col("caller").alias("source"), kind.alias("kind"), target.alias("target"), "file", "line", "project_id")


BARE = r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\(\)$', ''), '^.*(::|\.|->)', '', 's')"
EDGES = f"""edges as (select id, caller as source,
  case id % 4 when 0 then 'IMPORTS' when 1 then 'IMPLEMENTS' when 2 then 'INHERITS' else 'ROUTE' end as kind,
  case id % 4 when 0 then {BARE.format('callee')} when 3 then 'GET /' || callee else callee end as target, file, line, project_id
  from call_graph where callee is not null)"""

_CODES = {"rust": "rs", "python": "py", "typescript": "ts", "javascript": "js", "go": "go"}


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files: (file, language, content); the language by ``lang`` in any spelling, where it is missing by the ending of ``path``."""
    lang, end = F.lower(F.trim("lang")), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    code = None
    for k, v in _CODES.items():
        hit = (lang == k) | (lang == v) | (F.col("lang").isNull() & (end == v))
        code = F.when(hit, v) if code is None else code.when(hit, v)
    code = code.otherwise("md")
    file = F.concat_ws("/", F.lit("docs"), F.concat(F.col("doc_id").cast("string"), F.lit("."), code))
    return spread(table(spark, d, "documents").select("doc_id", "lang", "path", "text")).select("doc_id", file.alias("file"), code.alias("language"), F.col("text").alias("content"))


_CASE = " ".join(f"when lower(trim(lang)) in ('{k}', '{v}') or lang is null and lower(regexp_extract(path, '\\.(\\w+)$', 1)) = '{v}' then '{v}'" for k, v in _CODES.items())
SOURCES = f"""sources as (select doc_id, 'docs/' || doc_id || '.' || language as file, language, text as content from (select *, case {_CASE} else 'md' end as language from documents))"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents as added lines: (file, language, line, content)."""
    s = sources(spark, d)
    return s.select("file", "language", F.posexplode(F.split("content", "\n")).alias("_p", "content")).select("file", "language", (F.col("_p") + 1).alias("line"), "content")


LINES = SOURCES + """,
lines as (select file, language, cast(generate_subscripts(parts, 1) as int) as line, unnest(parts) as content
  from (select file, language, string_split(content, chr(10)) as parts from sources))"""


def fixes(spark: SparkSession, d: str) -> DataFrame:
    """Patch-like suggested fixes as unified diffs: (diff_id, text)."""
    i = table(spark, d, "review_issues").where(r"suggested_fix rlike '^[-+][^\n]*(\n[-+][^\n]*)*$'")
    head = F.format_string("--- a/%s\n+++ b/%s\n@@ -%d,%d +%d,%d @@\n", "file", "file", F.coalesce("line", F.lit(1)), _n("-"), F.coalesce("line", F.lit(1)), _n("+"))
    return i.select(F.col("id").alias("diff_id"), F.concat(head, "suggested_fix").alias("text"))


def _n(sign: str):
    return F.size(F.filter(F.split("suggested_fix", "\n"), lambda x: x.startswith(sign)))


FIXES = r"""fixes as (select id as diff_id, file, coalesce(line, 1) as start, string_split(suggested_fix, chr(10)) as parts
  from review_issues where regexp_matches(suggested_fix, '^[-+][^\n]*(\n[-+][^\n]*)*$')),
fix_pos as (select diff_id, file, start, generate_subscripts(parts, 1) as pos, unnest(parts) as raw from fixes),
diff_lines as (select diff_id, file, cast(pos - 1 as int) as line_seq, case when raw[1] = '+' then 'add' else 'remove' end as line_type, substr(raw, 2) as content,
  cast(case when raw[1] = '-' then start - 1 + sum(case when raw[1] = '-' then 1 else 0 end) over w end as int) as old_line_no,
  cast(case when raw[1] = '+' then start - 1 + sum(case when raw[1] = '+' then 1 else 0 end) over w end as int) as new_line_no
  from fix_pos window w as (partition by diff_id order by pos rows unbounded preceding))"""


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Findings with project, one spelling of severity, and a source by id."""
    r = table(spark, d, "reviews").groupBy("id").agg(F.min("project_id").alias("project_id")).withColumnRenamed("id", "review_id")
    i = table(spark, d, "review_issues").join(r, "review_id", "left")
    src = F.element_at(F.array(*[F.lit(s) for s in ("llm", "rules", "secrets", "security")]), (F.col("id") % 4 + 1).cast("int"))
    return i.select("id", "review_id", "project_id", "file", "line", F.lower(F.trim("severity")).alias("severity"), F.lower("issue_type").alias("issue_type"), "title", "body", "suggested_fix", "created_at", src.alias("source"))


ISSUES = """issues as (select i.id, i.review_id, r.project_id, i.file, i.line, lower(trim(i.severity)) as severity, lower(i.issue_type) as issue_type, i.title, i.body, i.suggested_fix,
  i.created_at, (['llm', 'rules', 'secrets', 'security'])[cast(i.id % 4 + 1 as int)] as source
  from review_issues i left join (select id, min(project_id) as project_id from reviews group by id) r on r.id = i.review_id)"""


_EVENTS = ("auto_resolved", "dismissed", "reopened", "opened")


def events_log(spark: SparkSession, d: str) -> DataFrame:
    """An event for every finding: resolved, dismissed, reopened or opened by id."""
    e = F.element_at(F.array(*[F.lit(x) for x in _EVENTS]), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "review_issues").select("id", F.col("id").alias("finding_id"), e.alias("event_type"), "created_at")


EVENTS = f"log as (select id, id as finding_id, ({list(_EVENTS)!r})[cast(id % 4 + 1 as int)] as event_type, created_at from review_issues)"


def latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    """(review_id) of the last review of each project, the largest id of equal times."""
    r = table(spark, d, "reviews").groupBy("project_id").agg(F.max(F.struct("created_at", "id")).alias("_l"))
    return r.select(F.col("_l.id").alias("review_id"))


LATEST = "latest as (select max(struct_pack(a := created_at, b := id)).b as review_id from reviews group by project_id)"
