"""Queries over the call graph and typed edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import graph as g
from loomgrid.plans import bindings as b
from loomgrid.plans import dsl
from loomgrid.sources.tables import table

P = b.PROJECT
NAME = "seal"


def callers(spark, d):
    return g.find_callers(b.calls(spark, d), NAME, P)


def callees(spark, d):
    return g.find_callees(b.calls(spark, d), NAME, P)


def cross_project_callers(spark, d):
    return g.find_callers_cross_project(b.calls(spark, d), table(spark, d, "projects"), NAME)


def impact_depth3(spark, d):
    return g.impact(b.calls(spark, d), NAME, P, 3)


def trace_out(spark, d):
    return g.trace(b.edges(spark, d), b.calls(spark, d), NAME, P, 2, True)


def trace_in(spark, d):
    return g.trace(b.edges(spark, d), b.calls(spark, d), NAME, P, 2, False)


def graph_proximity(spark, d):
    e = b.edges(spark, d)
    return g.proximity(b.symbols(spark, d), e, e.where(F.col("project_id") == P).agg(F.min("source")).first()[0] or "", P)


def arch_overview(spark, d):
    return g.arch_overview(b.symbols(spark, d), P)


def edge_kind_counts(spark, d):
    return g.edge_kind_counts(b.edges(spark, d), b.calls(spark, d))


def dead_code(spark, d):
    return g.dead_code(b.symbols(spark, d), b.calls(spark, d)).select("project_id", "name", "kind", "file", "line", "reason")


def unused_imports(spark, d):
    return g.unused_imports(b.edges(spark, d), b.calls(spark, d))


def routes_list(spark, d):
    return g.list_routes(b.edges(spark, d), "get", "/s")


def affected_tests(spark, d):
    changed = b.symbols(spark, d).where(F.col("file").startswith("src/")).select("file").distinct()
    return g.affected_tests(b.symbols(spark, d), b.calls(spark, d), changed, 1_000_000)


def breaking_changes(spark, d):
    from loomgrid.operators.diff import parse_diffs

    return g.breaking_changes(parse_diffs(b.fixes(spark, d)), b.calls(spark, d))


def changed_scan(spark, d):
    from loomgrid.operators.diff import parse_diffs

    return g.changed_scan(b.symbols(spark, d), b.calls(spark, d), b.edges(spark, d), parse_diffs(b.fixes(spark, d)), 50)


def index_scan(spark, d):
    return g.index_scan(b.symbols(spark, d), b.calls(spark, d), b.edges(spark, d), 50)


def dsl_callers(spark, d):
    return dsl.run(f"* -> {NAME}", b.calls(spark, d), b.symbols(spark, d), P)


def dsl_callees(spark, d):
    return dsl.run(f"{NAME} -> *", b.calls(spark, d), b.symbols(spark, d), P)


def dsl_functions(spark, d):
    return dsl.run("* -> *", b.calls(spark, d), b.symbols(spark, d), P)


QUERIES = {f.__name__: f for f in (callers, callees, cross_project_callers, impact_depth3, trace_out, trace_in, graph_proximity, arch_overview, edge_kind_counts, dead_code, unused_imports, routes_list, affected_tests, breaking_changes, changed_scan, index_scan, dsl_callers, dsl_callees, dsl_functions)}

_BARE = b.BARE
_CALLERS = f"select distinct caller, file, line from call_graph where callee ilike '%{NAME}%' and project_id = {P} order by file, line, caller limit 50"
_CALLEES = f"select distinct callee, file, line from call_graph where caller ilike '%{NAME}%' and project_id = {P} order by file, line, callee limit 50"
_WELL = ", ".join(f"'{x}'" for x in g.WELL_KNOWN)
_PRE = " ".join(f"and lower(name) not like '{x}%'" for x in g.ENTRY_PREFIXES)
_SUF = " ".join(f"and name not ilike '%{x}'" for x in g.ENTRY_SUFFIXES)
_DEAD = f"""dead as (select project_id, name, kind, file, line, 'no callers found' as reason from symbols s
 where kind in ('function', 'method', 'procedure') and name not in ({_WELL})
 and not exists (select 1 from call_graph c where c.project_id = s.project_id and c.callee = s.name)
 and name not ilike 'test_%' and name not ilike '%_test' and (signature is null or signature not ilike '%lint: keep%') {_PRE} {_SUF})"""
_UNUSED = """used as (select project_id, file, callee as t from call_graph union select project_id, file, source from edges where kind <> 'IMPORTS' union select project_id, file, target from edges where kind <> 'IMPORTS'),
unused as (select distinct project_id, file, target, line from edges e where kind = 'IMPORTS'
 and not exists (select 1 from used u where u.project_id = e.project_id and u.file = e.file and u.t = e.target))"""


def _impact_sql(depth: int) -> str:
    out = [f"e as (select distinct caller, callee, {_BARE.format('callee')} as bare, file, line from call_graph where project_id = {P} and caller is not null and callee is not null)"]
    out.append(f"h1 as (select caller as name, file, line, '{NAME}' as via, 1 as depth from (select *, row_number() over (order by file, line, caller) as r from (select distinct caller, callee, file, line from e where callee ilike '%{NAME}%')) where r <= 100)")
    for k in range(2, depth + 1):
        seen = " ".join(f"and name not in (select s from f{j})" for j in range(1, k - 1))
        out.append(f"f{k - 1} as (select distinct name as s from h{k - 1} where name <> '{NAME}' {seen})")
        out.append(f"h{k} as (select caller as name, file, line, bare as via, {k} as depth from (select e.*, row_number() over (partition by bare order by file, line, caller) as r from e where bare in (select s from f{k - 1})) where r <= 100)")
    return "with " + ",\n".join(out) + "\n" + " union all ".join(f"select * from h{k}" for k in range(1, depth + 1))


def _trace_sql(outgoing: bool) -> str:
    a, t = ("source", "target") if outgoing else ("target", "source")
    ca, cb = ("caller", "callee") if outgoing else ("callee", "caller")
    bare = _BARE.format("nd")
    return f"""with {b.EDGES},
te as (select {a} as nd, {t} as name, kind, file from edges where project_id = {P} and {t} is not null),
pe as (select {ca} as nd, {cb} as name, 'CALLS' as kind, file from call_graph where project_id = {P} and {cb} is not null),
t1 as (select '{NAME}' as sym, name, kind, file from te where nd ilike '%{NAME}%'),
p1 as (select '{NAME}' as sym, name, kind, file from pe where nd ilike '%{NAME}%' and not exists (select 1 from t1)),
n1 as (select distinct * from (select * from t1 union all select * from p1)),
h1 as (select distinct name, file, kind, 1 as depth from (select *, row_number() over (partition by sym order by kind, name, file) as r from n1) where r <= 100),
f1 as (select distinct {_BARE.format('name')} as s from h1 where {_BARE.format('name')} <> '{NAME}'),
t2 as (select {bare} as sym, name, kind, file from te where {bare} in (select s from f1)),
p2 as (select {bare} as sym, name, kind, file from pe where {bare} in (select s from f1) and {bare} not in (select sym from t2)),
n2 as (select distinct * from (select * from t2 union all select * from p2)),
h2 as (select distinct name, file, kind, 2 as depth from (select *, row_number() over (partition by sym order by kind, name, file) as r from n2) where r <= 100)
select * from h1 union all select * from h2"""


SQL = {
    "callers": _CALLERS,
    "callees": _CALLEES,
    "cross_project_callers": f"select distinct caller, file, line, root_path from call_graph c join projects p on p.id = c.project_id where callee ilike '%{NAME}%' order by root_path, file, line, caller limit 50",
    "impact_depth3": _impact_sql(3),
    "trace_out": _trace_sql(True),
    "trace_in": _trace_sql(False),
    "graph_proximity": f"""with {b.EDGES}, s0 as (select min(source) as s from edges where project_id = {P}),
n as (select target as name from edges, s0 where project_id = {P} and source = s union select source from edges, s0 where project_id = {P} and target = s),
h as (select distinct y.name, y.id from symbols y join n using (name), s0 where y.project_id = {P} and y.name <> s order by y.name, y.id limit 50)
select id, cast(row_number() over (order by name, id) as int) as rank, 1.0 / (row_number() over (order by name, id) + 1) as weight from h""",
    "arch_overview": f"select split_part(file, '/', 1) as module, count(*) as n_symbols, count(distinct kind) as n_kinds from symbols where project_id = {P} group by 1",
    "edge_kind_counts": f"with {b.EDGES} select kind, count(*) as n from edges group by 1",
    "dead_code": f"with {_DEAD} select * from dead",
    "unused_imports": f"with {b.EDGES}, {_UNUSED} select project_id, file, target, line from unused",
    "routes_list": f"with {b.EDGES} select 'GET' as method, substr(target, 5) as path, source as handler, file, line from edges where kind = 'ROUTE' and substr(target, 5) like '/s%'",
    "affected_tests": f"""with ch as (select distinct file from symbols where file like 'src/%'),
nm as (select distinct name from symbols where file in (select file from ch) and length(name) > 0),
bc as (select distinct file from call_graph where (lower(file) like '%test%' or lower(file) like '%spec%') and {_BARE.format('callee')} in (select name from nm)),
st as (select regexp_extract(file, '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1) as s from ch),
cd as (select unnest(['test_' || s, s || '_test', s || '.test', s || '.spec', s || '_spec', 'spec_' || s]) as c from st),
bn as (select distinct file from symbols where regexp_extract(file, '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1) in (select c from cd))
select file as test_file from (select file from bc union select file from bn) where file not in (select file from ch)""",
    "index_scan": f"""with {b.EDGES}, {_UNUSED}, {_DEAD},
u as (select 'index-unused-import' as rule_id, file, line, 'minor' as severity, target as name, 0 as o from unused union all select 'index-dead-code', file, line, 'info', name, 1 from dead)
select rule_id, file, line, severity, name from u order by o, file, line, name limit 50""",
    "dsl_callers": f"select caller as name, file, line from ({_CALLERS})",
    "dsl_callees": f"select callee as name, file, line from ({_CALLEES})",
    "dsl_functions": f"select distinct name, file, line from symbols where project_id = {P} and kind in ('function', 'procedure') order by file, line, name limit 50",
}
_GONE = " union all ".join(f"select file, old_line_no as line, regexp_extract(content, '{p}', 1) as name from diff_lines where line_type = 'remove'" for p in g.REMOVED)
SQL["breaking_changes"] = f"""with {b.FIXES}, gone as (select * from ({_GONE}) where length(name) >= 3),
cc as (select distinct {_BARE.format('callee')} as name, caller, file, line from call_graph), nc as (select name, least(count(*), 10) as n_callers from cc group by name)
select g.file, g.line, g.name, n_callers from gone g join nc using (name)"""
SQL["changed_scan"] = f"""with {b.EDGES}, {_UNUSED}, {b.FIXES}, ch as (select distinct file from diff_lines), ad as (select distinct file from diff_lines where line_type = 'add'),
dd as (select name, file, line from symbols s where kind in ('function', 'method', 'procedure') and name not in ({_WELL}) and file in (select file from ch)
 and not exists (select 1 from call_graph c where c.project_id = s.project_id and c.callee = s.name) and name not ilike 'test_%' and name not ilike '%_test'),
a as (select 'index-unused-import' as rule_id, file, line, 'minor' as severity, target as name from unused where file in (select file from ad) order by file, line, target limit 50),
z as (select 'index-dead-code' as rule_id, file, line, 'info' as severity, name from dd order by file, line, name limit 50)
select * from a union all select * from z"""
