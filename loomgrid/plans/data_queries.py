"""Store, diffs, packing, extraction, replies, context and windows, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions import paths
from loomgrid.operators import context, diff, extract, packing, replies, store, structure
from loomgrid.plans import bindings as b
from loomgrid.sources.tables import table
from loomgrid.streaming import incremental as inc

P = b.PROJECT


def _files(spark, d):
    return table(spark, d, "files")


def index_stats(spark, d):
    return store.index_stats(b.symbols(spark, d), _files(spark, d))


def kind_histogram(spark, d):
    return store.histogram(b.symbols(spark, d), "kind")


def language_histogram(spark, d):
    return store.histogram(_files(spark, d), "language")


def path_languages(spark, d):
    return _files(spark, d).groupBy(paths.language("path").alias("language"), paths.family("path").alias("family"), paths.is_test("path").alias("test"), paths.is_doc("path").alias("doc")).agg(F.count("*").alias("n"))


def latest_files(spark, d):
    return store.latest_files(_files(spark, d)).select("project_id", "path", "fingerprint", "symbol_count")


def changed_files(spark, d):
    now = _files(spark, d).select("project_id", "path", "fingerprint").distinct()
    return store.changed_files(now, _files(spark, d))


def replace_by_file(spark, d):
    s = b.symbols(spark, d)
    new = s.where("kind = 'method' and project_id = 1").withColumn("name", F.upper("name"))
    out = store.replace_by_file(s, new, s.where("project_id = 1").select("project_id", "file"))
    return out.select("id", "name", "file", "project_id")


def pruned_symbols(spark, d):
    t = {"files": _files(spark, d), "symbols": b.symbols(spark, d), "calls": b.calls(spark, d), "edges": b.edges(spark, d)}
    keep = _files(spark, d).where("path like 'src/%'").select("path")
    return store.prune(t, keep, P)["symbols"].select("id")


def deleted_project(spark, d):
    t = {"projects": table(spark, d, "projects"), "files": _files(spark, d), "symbols": b.symbols(spark, d)}
    out = store.delete_project(t, P)
    return out["symbols"].groupBy("project_id").agg(F.count("*").alias("n"))


def rebuild_needed(spark, d):
    return store.rebuild_needed(table(spark, d, "projects"), "a51d9f122542e1e7").select("id")


def stale_embeddings(spark, d):
    """Symbols to embed after those recorded before June were."""
    s = b.symbols(spark, d)
    before = s.where("created_at < timestamp_ntz'2025-06-01'")
    done = store.stale_embeddings(before, before.select("id", F.lit(0).cast("long").alias("text_hash")))
    return store.stale_embeddings(s, done).select("id", "text")


def diff_lines(spark, d):
    return diff.parse_diffs(b.fixes(spark, d)).select("diff_id", "file", "line_seq", "line_type", "content", "old_line_no", "new_line_no")


def diff_stats(spark, d):
    return diff.diff_stats(diff.parse_diffs(b.fixes(spark, d)))


def diff_files(spark, d):
    return diff.changed_files(diff.parse_diffs(b.fixes(spark, d)))


def line_numbers(spark, d):
    p = diff.parse_diffs(b.fixes(spark, d)).select("diff_id", "line_seq", "line_type", "old_start", "new_start")
    return diff.number_lines(p, ["diff_id"], "line_seq").select("diff_id", "line_seq", F.col("old_line_no").cast("int").alias("old_line_no"), F.col("new_line_no").cast("int").alias("new_line_no"))


def _many(spark, d):
    """All fixes of a review as one diff of many files."""
    f = b.fixes(spark, d).withColumnRenamed("diff_id", "id").join(table(spark, d, "review_issues").select("id", "review_id"), "id")
    return f.groupBy(F.col("review_id").alias("diff_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("text"))


def diff_chunks(spark, d):
    return diff.chunk_diffs(_many(spark, d), 400).select("diff_id", "index", "total", "label", "n_files")


def _packed(spark, d, **k):
    files = store.latest_files(_files(spark, d)).withColumn("size", F.split("fingerprint", ":")[1].cast("long"))
    return packing.pack(packing.costs(files, "path", None, "size"), "project_id", **k)


def pack_flat(spark, d):
    return _packed(spark, d)


def pack_smart(spark, d):
    return _packed(spark, d, strategy="smart")


def pack_by_language(spark, d):
    return _packed(spark, d, by="language")


def pack_merged(spark, d):
    return packing.merge_small(_packed(spark, d, by="directory"), "project_id", 3)


def pack_stats(spark, d):
    return packing.bundle_stats(_packed(spark, d), "project_id")


def _code(spark, d):
    return b.sources(spark, d).where("language != 'md'").select("file", "language", "content")


def extracted_symbols(spark, d):
    return extract.symbols(_code(spark, d))


def extracted_edges(spark, d):
    return extract.edges(_code(spark, d))


def structure_symbols(spark, d):
    """Definitions by the structure of the text, in all code documents."""
    return structure.symbols(_code(spark, d))


def structure_edges(spark, d):
    """Calls, imports and base types by the structure of the text."""
    return structure.edges(_code(spark, d))


def diff_references(spark, d):
    return extract.diff_references(diff.added_lines(diff.parse_diffs(b.fixes(spark, d))))


def diff_definitions(spark, d):
    """All lines of the source documents, as if they had just been added."""
    return extract.diff_definitions(b.lines(spark, d).where("language != 'md'"))


def reply_findings(spark, d):
    """Each review's findings written as one JSON reply, cut at three quarters for every third review, and read back."""
    i = b.issues(spark, d).select("review_id", "id", F.to_json(F.struct("file", "line", "severity", F.col("issue_type").alias("type"), "title")).alias("j"))
    g = i.groupBy("review_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "j"))), lambda x: x["j"]), ","), F.lit("]")).alias("t"))
    cut = F.when(F.col("review_id") % 3 == 0, F.expr("substring(t, 1, length(t) - length(t) div 4)")).otherwise(F.col("t"))
    out = replies.parse_replies(g.select(F.col("review_id").alias("reply_id"), cut.alias("text")))
    return out.groupBy("reply_id").agg(F.count("title").alias("n"), F.max("error").alias("error"))


def _resolved(spark, d):
    refs = b.calls(spark, d).select("file", F.col("callee").alias("name"), F.lit("call").alias("kind"))
    return context.resolve(refs, b.symbols(spark, d))


def context_resolved(spark, d):
    return _resolved(spark, d).select("ref_file", "name", "file", "line_from", "line_to")


def context_entries(spark, d):
    return context.drop_overlaps(_resolved(spark, d)).select("ref_file", "name", "file", "line_from", "line_to")


def context_callers(spark, d):
    """Callers of all methods, at most 20 each."""
    defs = b.symbols(spark, d).where("kind = 'method'").select("file", "name")
    return context.callers(defs, b.calls(spark, d)).select("ref_file", "name", "file", "line_from", "line_to")


def context_budget(spark, d):
    i = table(spark, d, "review_issues").where("suggested_fix is not null")
    e = i.select(F.col("review_id").alias("review"), F.col("id").cast("int").alias("seq"), F.when(F.col("id") % 2 == 0, "function").otherwise("caller").alias("kind"), F.col("suggested_fix").alias("content"))
    return context.assemble(e, 200).groupBy("review").agg(F.count("*").alias("n"), F.sum("used").alias("used"), F.max("budget_hit").alias("budget_hit"))


def events_tumbling(spark, d):
    return inc.tumbling(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def events_sliding(spark, d):
    return inc.sliding(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def events_sessions(spark, d):
    return inc.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def event_ranks(spark, d):
    """Window functions: rank of each event in its user's values, the previous value, and a running sum."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.rank().over(W.partitionBy("user_id").orderBy(F.desc("value"))).cast("long").alias("rank"), F.lag("value").over(w).alias("previous"), F.round(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 4).alias("running"))


def order_cube(spark, d):
    """Grouping sets: orders by status and priority, with all totals."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        index_stats, kind_histogram, language_histogram, path_languages, latest_files, changed_files, replace_by_file, pruned_symbols, deleted_project, rebuild_needed, stale_embeddings, diff_lines, diff_stats,
        diff_files, line_numbers, diff_chunks, pack_flat, pack_smart, pack_by_language, pack_merged, pack_stats, extracted_symbols, extracted_edges, structure_symbols, structure_edges, diff_references, diff_definitions, reply_findings,
        context_resolved, context_entries, context_callers, context_budget, events_tumbling, events_sliding, events_sessions, event_ranks, order_cube,
    )
}

_LAST = "last_ as (select project_id, path, max(struct_pack(a := last_indexed, b := fingerprint, c := language, d := symbol_count)) as r from files group by 1, 2)"
_EXT = "lower(regexp_extract(path, '([^.]*)$', 1))"


def _map(table_: dict, default: str) -> str:
    return "case " + " ".join(f"when {_EXT} in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in table_.items()) + f" else '{default}' end"


SQL = {
    "index_stats": """with s as (select project_id, count(*) as n_symbols, count(distinct kind) as n_kinds from symbols group by 1), f as (select project_id, count(distinct path) as n_files from files group by 1)
select coalesce(s.project_id, f.project_id) as project_id, coalesce(n_symbols, 0) as n_symbols, coalesce(n_files, 0) as n_files, coalesce(n_kinds, 0) as n_kinds from s full join f on s.project_id = f.project_id""",
    "kind_histogram": "select kind as value, count(*) as n from symbols group by 1",
    "language_histogram": "select coalesce(language, 'unknown') as value, count(*) as n from files group by 1",
    "path_languages": f"""select {_map(paths.LANGUAGES, 'unknown')} as language, case when contains(path, '.') then {_map(paths.FAMILIES, 'other')} else 'other' end as family,
list_has_any(regexp_split_to_array(lower(path), '[/_\\-.]'), {paths.TEST_WORDS!r}) as test, contains(path, '.') and {_EXT} in ({', '.join(repr(x) for x in paths.DOC_ENDINGS)}) as doc, count(*) as n from files group by 1, 2, 3, 4""",
    "latest_files": f"with {_LAST} select project_id, path, r.b as fingerprint, r.d as symbol_count from last_",
    "changed_files": "with l as (select project_id, path, arg_max(fingerprint, last_indexed) as k from files group by 1, 2) select distinct f.project_id, f.path, f.fingerprint from files f join l using (project_id, path) where f.fingerprint is distinct from k",
    "replace_by_file": "select id, name, file, project_id from symbols where project_id <> 1 union all select id, upper(name), file, project_id from symbols where project_id = 1 and kind = 'method'",
    "pruned_symbols": "select id from symbols s where not (project_id = 1 and exists (select 1 from files f where f.project_id = 1 and f.path = s.file) and s.file not like 'src/%')",
    "deleted_project": "select project_id, count(*) as n from symbols where project_id <> 1 group by 1",
    "rebuild_needed": "select id from projects where index_config_hash is distinct from 'a51d9f122542e1e7'",
    "stale_embeddings": "select id, case when coalesce(signature, '') = '' then name else name || ' ' || signature end as text from symbols where created_at >= timestamp '2025-06-01'",
    "diff_lines": f"with {b.FIXES} select diff_id, file, line_seq, line_type, content, cast(old_line_no as int) as old_line_no, cast(new_line_no as int) as new_line_no from diff_lines",
    "diff_stats": f"with {b.FIXES} select diff_id, cast(1 as bigint) as n_files, count(*) as n_changed from diff_lines group by 1",
    "diff_files": f"with {b.FIXES} select diff_id, file from fixes",
    "line_numbers": f"with {b.FIXES} select diff_id, line_seq, cast(old_line_no as int) as old_line_no, cast(new_line_no as int) as new_line_no from diff_lines",
    "events_tumbling": "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "events_sliding": "select date_trunc('day', ts) - to_days(cast(k as int)) as start, event_type, count(*) as n from events, range(7) r(k) group by 1, 2",
    "events_sessions": """with g as (select *, case when ts - lag(ts) over w < interval 12 hours then 0 else 1 end as new_ from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new_) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""",
    "event_ranks": """select event_id, rank() over (partition by user_id order by value desc) as rank, lag(value) over w as previous,
round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running from events window w as (partition by user_id order by ts, event_id)""",
    "order_cube": "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)",
}
_NAMED = " union all ".join(
    f"select file, line, content, {i} as o, '{k}' as kind, regexp_extract(content, '{p}', 1) as name from lines where language in ('{lang}'{', ' + repr('js') if lang == 'ts' else ''}) and regexp_matches(content, '{p}')"
    for lang in ("rs", "py", "ts", "go")
    for i, (k, p) in enumerate(extract.DEFINITIONS[lang])
)
SQL["extracted_symbols"] = f"""with {b.LINES}, named as ({_NAMED}), first_ as (select *, row_number() over (partition by file, line, name order by o) as r from named where name <> '')
select file, cast(line as int) as line, kind, name, trim(content) as signature from first_ where r = 1"""
_BARE = r"regexp_replace(regexp_replace(regexp_replace(callee, '^\s+|\s+$', '', 'g'), '\(\)$', ''), '^.*(::|\.|->)', '', 's')"
SQL["context_resolved"] = f"""with r as (select distinct file as ref_file, {_BARE} as name from call_graph where length({_BARE}) >= 2),
j as (select distinct r.ref_file, r.name, s.file, s.line from r join symbols s on s.name = r.name where s.file <> r.ref_file),
k as (select *, row_number() over (partition by ref_file, name order by file, line) as n from j)
select ref_file, name, file, line as line_from, line + 50 as line_to from k where n <= 5"""
SQL["context_callers"] = f"""with d as (select distinct file as ref_file, name from symbols where kind = 'method'), c as (select distinct {_BARE} as name, caller, file, line from call_graph where {_BARE} in (select name from d)),
k as (select *, row_number() over (partition by name order by file, line, caller) as n from c)
select d.ref_file, d.name, k.file, greatest(k.line - 1, 1) as line_from, k.line + 1 as line_to from d join k using (name) where n <= 20 and k.file <> d.ref_file"""
_TYPES = "('class', 'struct', 'enum', 'trait', 'interface', 'type_alias')"
SQL["diff_definitions"] = f"""with {b.LINES}, named as ({_NAMED}), first_ as (select *, row_number() over (partition by file, line, name order by o) as r from named where name <> ''),
k as (select file, name, line, case when kind in ('function', 'method') then 'function' else 'type' end as kind from first_ where r = 1 and (kind in ('function', 'method') or kind in {_TYPES})
 and name not in ({', '.join(repr(x) for x in extract._NO_DEFINITION)}))
select file, name, arg_min(kind, struct_pack(l := line, k := kind)) as kind from k group by 1, 2"""

_DIR = r"case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') when contains(path, '\') then regexp_replace(path, '\\[^\\]*$', '') else '.' end"
_FAM = f"case when contains(path, '.') then {_map(paths.FAMILIES, 'other')} else 'other' end"
_FAM_RANK = "case fam " + " ".join(f"when '{f}' then {i}" for i, f in enumerate(paths.FAMILY_ORDER)) + " end"


def _pack_sql(order: str, kind: str = "null", part: str = "''") -> str:
    """The fold over a job's files as a recursive query: one file a step."""
    full = "(w.n >= 20 or w.total + f.cost > 60000 or f.part <> w.part or coalesce(w.n >= 2 and f.kind <> w.kind and w.total + f.cost > 45000, false))"
    return f"""files_ as (select project_id, path, cast(coalesce(cast(split_part(r.b, ':', 2) as bigint), 0) + octet_length(encode(path)) + 20 as bigint) as cost, {_DIR} as dir, {_FAM} as fam from last_),
seq as (select *, {kind} as kind, {part} as part, row_number() over (partition by project_id order by {order}) as r from files_),
walk as (select project_id, path, cost, kind, part, r, 0 as bundle, cost as total, 1 as n from seq where r = 1
  union all select f.project_id, f.path, f.cost, f.kind, f.part, f.r, w.bundle + case when {full} then 1 else 0 end, case when {full} then f.cost else w.total + f.cost end, case when {full} then 1 else w.n + 1 end
  from walk w join seq f on f.project_id = w.project_id and f.r = w.r + 1),
packed as (select project_id, path, cast(bundle as int) as bundle, cost from walk)"""


SQL["pack_flat"] = f"with recursive {_LAST}, {_pack_sql('path')} select * from packed"
SQL["pack_smart"] = f"with recursive {_LAST}, {_pack_sql(f'dir, {_FAM_RANK}, path', 'dir || chr(1) || fam')} select * from packed"
SQL["pack_by_language"] = f"with recursive {_LAST}, {_pack_sql('fam, path', part='fam')} select * from packed"
SQL["pack_stats"] = f"""with recursive {_LAST}, {_pack_sql('path')}, bn as (select project_id, bundle, count(*) as n, sum(cost) as c from packed group by 1, 2)
select project_id, count(*) as bundles, cast(sum(n) as bigint) as files, cast(sum(c) as bigint) as chars, avg(n) as avg_files, avg(c) as avg_chars, count(*) filter (where n = 1) as single_file_bundles from bn group by 1"""
SQL["pack_merged"] = f"""with recursive {_LAST}, {_pack_sql('dir, path', part='dir')}, bn as (select project_id, bundle, count(*) as n, cast(sum(cost) as bigint) as c from packed group by 1, 2),
mg as (select project_id, bundle, 0 as merged, n, c from bn where bundle = 0
  union all select b.project_id, b.bundle, m.merged + case when {{ok}} then 0 else 1 end, case when {{ok}} then m.n + b.n else b.n end, case when {{ok}} then m.c + b.c else b.c end
  from mg m join bn b on b.project_id = m.project_id and b.bundle = m.bundle + 1)
select p.project_id, path, cast(merged as int) as bundle, cost from packed p join mg on mg.project_id = p.project_id and mg.bundle = p.bundle""".replace("{ok}", "m.n < 3 and b.n < 3 and m.n + b.n <= 20 and m.c + b.c <= 60000")
SQL["diff_chunks"] = rf"""with recursive {b.FIXES}, blocks as (select i.review_id as diff_id, i.id, f.file, split_part(f.file, '/', 1) as top,
  octet_length(encode('--- a/' || f.file || chr(10) || '+++ b/' || f.file || chr(10) || '@@ -' || start || ',' || len(list_filter(parts, lambda x: x[1] = '-')) || ' +' || start || ',' || len(list_filter(parts, lambda x: x[1] = '+')) || ' @@' || chr(10) || array_to_string(parts, chr(10)))) as size
  from fixes f join review_issues i on i.id = f.diff_id),
seq as (select *, row_number() over (partition by diff_id order by id) as r from blocks),
walk as (select diff_id, top, r, size as total, 0 as chunk from seq where r = 1
  union all select s.diff_id, s.top, s.r, case when w.total + s.size > 400 then s.size else w.total + s.size end, w.chunk + case when w.total + s.size > 400 then 1 else 0 end from walk w join seq s on s.diff_id = w.diff_id and s.r = w.r + 1),
g as (select diff_id, chunk, count(*) as n_files, list_sort(list(distinct top)) as tops from walk group by 1, 2)
select diff_id, cast(chunk as int) as index, cast(max(chunk) over (partition by diff_id) + 1 as int) as total,
  case when len(tops) = 1 then tops[1] || '/*' when len(tops) <= 3 then array_to_string(tops, ', ') else len(tops) || ' dirs' end as label, cast(n_files as int) as n_files from g"""

SQL["context_entries"] = f"""with recursive {SQL['context_resolved'].removeprefix('with ').replace('select ref_file, name, file, line as line_from, line + 50 as line_to from k where n <= 5', '')},
res as (select distinct ref_file, name, file, line as line_from, line + 50 as line_to from k where n <= 5),
seq as (select *, row_number() over (partition by ref_file, file order by line_from, line_to, name) as q from res),
walk as (select *, true as kept, line_to as upto from seq where q = 1
  union all select s.*, s.line_from > w.upto, case when s.line_from > w.upto then s.line_to else w.upto end from walk w join seq s on s.ref_file = w.ref_file and s.file = w.file and s.q = w.q + 1)
select ref_file, name, file, line_from, line_to from walk where kept""".replace("),\n,", "),\n").replace(")\n,", "),\n")
SQL["context_budget"] = r"""with recursive e as (select review_id as review, cast(id as int) as seq, id % 2 = 0 as fn, suggested_fix as c, string_split(suggested_fix, chr(10)) as ls from review_issues where suggested_fix is not null),
m as (select *, case when fn then 50 else 4 end as cap, list_position(list_transform(ls[1:4], lambda x: contains(x, '{')), true) as brace from e),
t as (select *, array_to_string(ls[1:cap], chr(10)) || case when len(ls) > cap then chr(10) || '...' else '' end as whole, array_to_string(ls[1:coalesce(nullif(brace, 0), 4)], chr(10)) as sig from m),
n as (select *, case when octet_length(encode(whole)) = 0 then 0 else greatest(1, octet_length(encode(whole)) // 4) end as n1, case when octet_length(encode(sig)) = 0 then 0 else greatest(1, octet_length(encode(sig)) // 4) end as n2,
  row_number() over (partition by review order by case when fn then 0 else 3 end, seq) as q from t),
p as (select review, q, c <> '' as filled, n1, n2 from n),
walk as (select review, q, case when n1 between 1 and 200 then n1 when n2 between 1 and 200 then n2 else 0 end as take, case when n1 between 1 and 200 then n1 when n2 between 1 and 200 then n2 else 0 end as used, filled and not (n1 between 1 and 200 or n2 between 1 and 200) as hit from p where q = 1
  union all select p.review, p.q, case when n1 > 0 and used + n1 <= 200 then n1 when n2 > 0 and used + n2 <= 200 then n2 else 0 end, used + case when n1 > 0 and used + n1 <= 200 then n1 when n2 > 0 and used + n2 <= 200 then n2 else 0 end,
  hit or filled and not (n1 > 0 and used + n1 <= 200 or n2 > 0 and used + n2 <= 200) from walk w join p on p.review = w.review and p.q = w.q + 1)
select review, count(*) filter (where take > 0) as n, cast(sum(take) as bigint) as used, bool_or(hit) as budget_hit from walk group by 1 having sum(take) > 0"""
