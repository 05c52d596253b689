"""Queries over the call graph and typed edges.

Call rows have caller, callee, file, line, project_id; edge rows have source,
kind, target, file, line, project_id.  Name arguments match as the search of a
code index does: anywhere in the name, without regard to case, with % and _ as
wildcards.  Every limit comes after a total order, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.names import bare_name
from loomgrid.functions.paths import contains_like, entry_point, module
from loomgrid.workspace import Workspace

FANOUT = 100

# Names that are called without being named, and marks of framework entry points.
WELL_KNOWN = """main new drop default clone eq hash fmt debug display from_str into from try_from try_into deref deref_mut index
index_mut add sub mul div rem neg not bitand bitor bitxor shl shr partial_eq partial_ord eq_ignore_ascii_case is_ascii
to_lowercase to_uppercase trim trim_start trim_end as_str as_bytes as_mut as_ref into_iter iter next map filter fold collect
len is_empty contains push pop insert remove clear get get_mut with_capacity to_vec to_string parse unwrap expect ok err
is_ok is_err is_some is_none take replace lock read write flush close connect accept bind listen send recv shutdown spawn
join sleep yield_now block_on from_secs from_millis elapsed instant system_time now duration_since""".split()
ENTRY_PREFIXES = """handle_ load create preload update render component_did_mount on_mount on_destroy handle process execute
serve start stop run resolve_""".split()
ENTRY_SUFFIXES = "Handler Listener Callback Middleware Route Hook Plugin Provider".split()
CALLABLE = ["function", "method", "procedure"]


def _scope(df: DataFrame, project: int | None) -> DataFrame:
    return df if project is None else df.where(F.col("project_id") == project)


def find_callers(calls: DataFrame, name: str, project: int | None = None, limit: int = 50) -> DataFrame:
    """Distinct (caller, file, line) of calls whose callee matches."""
    d = _scope(calls, project).where(contains_like("callee", name)).select("caller", "file", "line").distinct()
    return d.orderBy("file", "line", "caller").limit(limit)


def find_callees(calls: DataFrame, name: str, project: int | None = None, limit: int = 50) -> DataFrame:
    """Distinct (callee, file, line) of calls whose caller matches."""
    d = _scope(calls, project).where(contains_like("caller", name)).select("callee", "file", "line").distinct()
    return d.orderBy("file", "line", "callee").limit(limit)


def find_callers_cross_project(calls: DataFrame, projects: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Callers in every project, with the project's root."""
    c = calls.where(contains_like("callee", name)).select("caller", "file", "line", "project_id")
    p = projects.select(F.col("id").alias("project_id"), "root_path")
    return c.join(p, "project_id").select("caller", "file", "line", "root_path").distinct().orderBy("root_path", "file", "line", "caller").limit(limit)


def callers_or_cross_project(calls: DataFrame, projects: DataFrame, name: str, project: int, limit: int = 50) -> DataFrame:
    """Callers in the project, or in all projects when it has none; root_path is null for the project's own."""
    own = find_callers(calls, name, project, limit).withColumn("root_path", F.lit(None).cast("string"))
    none = own.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    return own.unionByName(find_callers_cross_project(calls, projects, name, limit).join(F.broadcast(none)).drop("_n"))


def _capped(hits: DataFrame, order: list[str]) -> DataFrame:
    w = W.partitionBy("sym").orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= FANOUT).drop("_r")


def impact(calls: DataFrame, name: str, project: int | None = None, depth: int = 3, ws: Workspace | None = None) -> DataFrame:
    """(name, file, line, via, depth): who calls the name, who calls those, and so on.

    The asked name matches as in ``find_callers``; the names it leads to join by
    equality on the bare callee, so a level is a hash join and never a scan of all
    pairs.  Each name is expanded once, at the depth at which it is first met,
    through at most FANOUT callers in order of file and line; a row comes out for
    each edge, so a caller of two names comes out twice.
    """
    ws = ws or Workspace(calls.sparkSession, "impact")
    edges = _scope(calls, project).where("caller is not null and callee is not null").select("caller", "callee", "file", "line").distinct()
    hit = edges.where(contains_like("callee", name)).withColumn("sym", F.lit(name))
    out, seen = None, None
    for d in range(1, depth + 1):
        step = ws.write(_capped(hit, ["file", "line", "caller"]).select(F.col("caller").alias("name"), "file", "line", F.col("sym").alias("via"), F.lit(d).alias("depth")), f"hit{d}")
        out = step if out is None else out.unionByName(step)
        if d == depth:
            break
        new = step.select(F.col("name").alias("sym")).where(F.col("sym") != name).distinct()
        new = ws.write(new if seen is None else new.join(seen, "sym", "left_anti"), f"front{d}")
        if not new.limit(1).count():
            break
        seen = new if seen is None else seen.unionByName(new)
        hit = edges.withColumn("sym", bare_name("callee")).join(new, "sym")
    return out.orderBy("depth", "file", "line", "name", "via")


def trace(edges: DataFrame, calls: DataFrame, name: str, project: int | None = None, depth: int = 3, outgoing: bool = True, ws: Workspace | None = None) -> DataFrame:
    """(name, file, kind, depth) reached along typed edges, or along calls where a name has no typed edge.

    Matching as in ``impact``; a name is expanded once, every edge to a neighbour comes out.
    """
    ws = ws or Workspace(calls.sparkSession, "trace")
    a, b = ("source", "target") if outgoing else ("target", "source")
    ca, cb = ("caller", "callee") if outgoing else ("callee", "caller")
    e = _scope(edges, project).select(F.col(a).alias("_at"), F.col(b).alias("name"), "kind", "file").where("name is not null")
    c = _scope(calls, project).select(F.col(ca).alias("_at"), F.col(cb).alias("name"), F.lit("CALLS").alias("kind"), "file").where("name is not null")
    front, seen, out = None, None, None
    for d in range(1, depth + 1):
        if front is None:
            typed = e.where(contains_like("_at", name)).withColumn("sym", F.lit(name))
            plain = c.where(contains_like("_at", name)).withColumn("sym", F.lit(name))
        else:
            typed = e.withColumn("sym", bare_name("_at")).join(front, "sym")
            plain = c.withColumn("sym", bare_name("_at")).join(front, "sym")
        cols = ["sym", "name", "kind", "file"]
        plain = plain.select(*cols).join(typed.select("sym").distinct(), "sym", "left_anti")
        n = typed.select(*cols).unionByName(plain.select(*cols)).distinct()
        step = ws.write(_capped(n, ["kind", "name", "file"]).select("name", "file", "kind", F.lit(d).alias("depth")).distinct(), f"hit{d}")
        out = step if out is None else out.unionByName(step)
        new = step.select(bare_name("name").alias("sym")).where(F.col("sym") != name).distinct()
        front = ws.write(new if seen is None else new.join(seen, "sym", "left_anti"), f"front{d}")
        if d == depth or not front.limit(1).count():
            break
        seen = front if seen is None else seen.unionByName(front)
    return out.distinct().orderBy("depth", "file", "name", "kind")


def proximity(symbols: DataFrame, edges: DataFrame, seed: str, project: int | None = None, limit: int = 50) -> DataFrame:
    """Symbols one edge away from the seed name, in either direction, the seed left out; (id, rank, weight).

    The condition "source or target" is planned as two equality joins and a distinct.
    """
    e, s = _scope(edges, project), _scope(symbols, project)
    to = e.where(F.col("source") == seed).select(F.col("target").alias("name"))
    of = e.where(F.col("target") == seed).select(F.col("source").alias("name"))
    n = to.unionByName(of).where(F.col("name") != seed).distinct()
    hit = s.join(n, "name").select("id", "name").distinct().orderBy("name", "id").limit(limit)
    r = F.row_number().over(W.orderBy("name", "id"))
    return hit.select("id", r.alias("rank"), (1.0 / (r + 1)).alias("weight"))


def arch_overview(symbols: DataFrame, project: int | None = None) -> DataFrame:
    """(module, n_symbols, n_kinds) by first path segment."""
    return _scope(symbols, project).groupBy(module("file").alias("module")).agg(F.count("*").alias("n_symbols"), F.countDistinct("kind").alias("n_kinds")).orderBy(F.desc("n_symbols"), "module")


def edge_kind_counts(edges: DataFrame, calls: DataFrame, project: int | None = None) -> DataFrame:
    """(kind, n) of the typed edges, or the number of calls where there are no edges."""
    e = _scope(edges, project).groupBy("kind").agg(F.count("*").alias("n"))
    none = e.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    c = _scope(calls, project).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("CALLS").alias("kind"), "n")
    return e.unionByName(c.join(F.broadcast(none)).drop("_n")).orderBy(F.desc("n"), "kind")


def _uncalled(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Callable symbols that no call names exactly, in their project."""
    s = symbols.where(F.col("kind").isin(CALLABLE) & ~F.col("name").isin(WELL_KNOWN))
    called = calls.where("project_id is not null and callee is not null").select("project_id", F.col("callee").alias("name")).distinct()
    return s.join(called, ["project_id", "name"], "left_anti")


def _no_tests(name: str = "name") -> Column:
    return ~F.col(name).ilike("test_%") & ~F.col(name).ilike("%_test")


def dead_code(symbols: DataFrame, calls: DataFrame, project: int | None = None, include_tests: bool = False, keep_marker: str = "lint: keep", entry_points: list[str] | None = None) -> DataFrame:
    """(project_id, name, kind, file, line, signature, reason) of callable symbols without callers.

    Left out are well-known names, tests unless asked for, signatures with the
    keep marker, framework entry points by prefix or suffix, and given patterns.
    """
    d = _uncalled(_scope(symbols, project), _scope(calls, project))
    if not include_tests:
        d = d.where(_no_tests())
    if keep_marker:
        d = d.where(F.col("signature").isNull() | ~contains_like("signature", keep_marker))
    for p in ENTRY_PREFIXES:
        d = d.where(~F.lower("name").like(p + "%"))
    for x in ENTRY_SUFFIXES:
        d = d.where(~F.col("name").ilike("%" + x))
    if entry_points:
        d = d.where(~entry_point("name", entry_points))
    return d.select("project_id", "name", "kind", "file", "line", "signature", F.lit("no callers found").alias("reason")).orderBy("project_id", "file", "line", "name")


def dead_code_in_file(symbols: DataFrame, calls: DataFrame, file: str, project: int, include_tests: bool = False) -> DataFrame:
    """The same for one file, with only well-known names and tests left out."""
    d = _uncalled(_scope(symbols, project).where(F.col("file") == file), _scope(calls, project))
    if not include_tests:
        d = d.where(_no_tests())
    return d.select("name", "kind", "file", "line", "signature", F.lit("no callers found").alias("reason")).orderBy("line", "name")


def unused_imports(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(project_id, file, target, line) of imports whose target is neither called nor an end of another edge in its file."""
    key = ["project_id", "file", "target"]
    imports = edges.where("kind = 'IMPORTS'").select(*key, "line").distinct()
    other = edges.where("kind != 'IMPORTS'")
    used = calls.select("project_id", "file", F.col("callee").alias("target")).unionByName(other.select("project_id", "file", F.col("source").alias("target"))).unionByName(other.select(*key)).distinct()
    return imports.join(used, key, "left_anti").orderBy("project_id", "file", "line", "target")


def list_routes(edges: DataFrame, method: str | None = None, prefix: str | None = None) -> DataFrame:
    """(method, path, handler, file, line) of ROUTE edges; a target without a method has method ''."""
    t = F.col("target")
    has = t.rlike("^[A-Za-z]+ ")
    d = edges.where("kind = 'ROUTE'").select(
        F.when(has, F.regexp_extract(t, "^([A-Za-z]+) ", 1)).otherwise("").alias("method"), F.when(has, F.regexp_extract(t, "(?s)^[A-Za-z]+ (.*)$", 1)).otherwise(t).alias("path"), F.col("source").alias("handler"), "file", "line", t.alias("_t")
    )
    if method:
        d = d.where(F.lower("method") == method.lower())
    if prefix:
        d = d.where(F.col("path").startswith(prefix))
    return d.orderBy("_t", "file", "line").drop("_t")


def affected_tests(symbols: DataFrame, calls: DataFrame, changed: DataFrame, per_name: int = FANOUT) -> DataFrame:
    """(test_file): tests that call a symbol of a changed file, and test files named after one.

    ``changed`` has a column file; it is the query side and is broadcast only by
    the optimizer's own size check.  Names join by equality on the bare callee
    first and by containment only for callees that carry a qualifier.
    """
    f = changed.select("file").distinct()
    names = symbols.join(f, "file", "left_semi").where(F.length("name") > 0).select("name").distinct()
    looks = F.lower("file").contains("test") | F.lower("file").contains("spec")
    hit = calls.where(looks).withColumn("name", bare_name("callee")).join(names, "name").select("name", F.col("file").alias("test_file")).distinct()
    w = W.partitionBy("name").orderBy("test_file")
    by_call = hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_name).select("test_file")
    stem = F.regexp_extract("file", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    cand = f.select(F.explode(F.array(*[F.format_string(p, stem) for p in ("test_%s", "%s_test", "%s.test", "%s.spec", "%s_spec", "spec_%s")])).alias("cand")).distinct()
    paths = symbols.select("file").distinct().withColumn("cand", F.regexp_extract("file", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))
    by_name = paths.join(cand, "cand", "left_semi").select(F.col("file").alias("test_file"))
    return by_call.unionByName(by_name).distinct().join(f.select(F.col("file").alias("test_file")), "test_file", "left_anti").orderBy("test_file")


def symbol_callers(calls: DataFrame, names: DataFrame, per_name: int) -> DataFrame:
    """(name, caller, file, line): at most per_name callers of each given name, by bare name."""
    hit = calls.withColumn("name", bare_name("callee")).join(names.select("name").distinct(), "name").select("name", "caller", "file", "line").distinct()
    w = W.partitionBy("name").orderBy("file", "line", "caller")
    return hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_name).drop("_r")


# Declarations whose removal may break a caller.
REMOVED = [r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", r"(?:async\s+)?def\s+(\w+)", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", r"func\s+(?:\([^)]*\)\s*)?(\w+)"]


def breaking_changes(diff_lines: DataFrame, calls: DataFrame, per_name: int = 10, skip: list[str] | None = None) -> DataFrame:
    """(file, line, name, n_callers): removed declarations that are still called; a line that fits several patterns counts for each."""
    from loomgrid.functions.paths import skip_regex

    r = diff_lines.where("line_type = 'remove'")
    for p in skip or []:
        r = r.where(~F.col("file").rlike(skip_regex(p)))
    found = F.explode(F.array(*[F.regexp_extract("content", p, 1) for p in REMOVED]))
    gone = r.select("file", F.col("old_line_no").alias("line"), found.alias("name")).where(F.length("name") >= 3)
    callers = symbol_callers(calls, gone, per_name).groupBy("name").agg(F.count("*").alias("n_callers"))
    return gone.join(callers, "name").select("file", "line", "name", "n_callers").orderBy("file", "line", "name")


def changed_scan(symbols: DataFrame, calls: DataFrame, edges: DataFrame, diff_lines: DataFrame, cap: int = 10, skip: list[str] | None = None) -> DataFrame:
    """(rule_id, file, line, severity, name): unused imports of files with added lines, and uncalled symbols of changed files, at most ``cap`` each.

    Deleted files and files that match a skip pattern are left out.
    """
    from loomgrid.functions.paths import skip_regex

    live = diff_lines.where(~F.col("is_deleted"))
    for p in skip or []:
        live = live.where(~F.col("file").rlike(skip_regex(p)))
    changed = live.select("file").distinct()
    added = live.where("line_type = 'add'").select("file").distinct()
    a = unused_imports(edges, calls).join(added, "file", "left_semi").select(F.lit("index-unused-import").alias("rule_id"), "file", "line", F.lit("minor").alias("severity"), F.col("target").alias("name"))
    d = _uncalled(symbols.join(changed, "file", "left_semi"), calls).where(_no_tests())
    b = d.select(F.lit("index-dead-code").alias("rule_id"), "file", "line", F.lit("info").alias("severity"), "name")
    return a.orderBy("file", "line", "name").limit(cap).unionByName(b.orderBy("file", "line", "name").limit(cap))


def index_scan(symbols: DataFrame, calls: DataFrame, edges: DataFrame, cap: int = 50) -> DataFrame:
    """Project-wide findings of the index: unused imports first, then dead code, up to the cap."""
    a = unused_imports(edges, calls).select(F.lit("index-unused-import").alias("rule_id"), "file", "line", F.lit("minor").alias("severity"), F.col("target").alias("name"), F.lit(0).alias("_o"))
    b = dead_code(symbols, calls).select(F.lit("index-dead-code").alias("rule_id"), "file", "line", F.lit("info").alias("severity"), "name", F.lit(1).alias("_o"))
    return a.unionByName(b).orderBy("_o", "file", "line", "name").limit(cap).drop("_o")
