"""Queries of problems 3 and 4 over the whole call_graph and symbols tables, with their SQL."""

from __future__ import annotations

from loomgrid.operators import hierarchy as hi
from loomgrid.operators import references as rf
from loomgrid.sources.tables import table


def _calls(spark, d):
    return table(spark, d, "call_graph")


def _symbols(spark, d):
    return table(spark, d, "symbols")


def p3_found(spark, d):
    return rf.orphan_references(_calls(spark, d), _symbols(spark, d)).select("call_id", "state")


def p3_orphan_periods(spark, d):
    return rf.orphan_periods(rf.orphan_references(_calls(spark, d), _symbols(spark, d)))


def p3_orphan_keys(spark, d):
    refs = rf.call_references(_calls(spark, d))
    state = rf.reference_deltas(refs).unionByName(rf.existence_deltas(_symbols(spark, d)))
    return rf.orphan_keys(state).select("project_id", "name", "refs", "first_ref")


def _hierarchy(spark, d):
    return hi.build_hierarchy(hi.call_links(_calls(spark, d), _symbols(spark, d)))


def p4_found(spark, d):
    return hi.node_roots(_hierarchy(spark, d))


def p4_paths(spark, d):
    return hi.node_paths(_hierarchy(spark, d))


def p4_descendants(spark, d):
    return hi.descendants(_hierarchy(spark, d))


def p4_rings(spark, d):
    return hi.ring_members(_hierarchy(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_orphan_periods, p3_orphan_keys, p4_found, p4_paths, p4_descendants, p4_rings)}

_BARE = r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\(\)$', ''), '^.*(::|\.|->)', '', 's')"
_REFS = f"""refs as (
  select id as call_id, project_id, {_BARE.format('callee')} as name, {_BARE.format('caller')} as up, indexed_at
  from call_graph where project_id is not null and regexp_matches(callee, '\\S')),
defs as (select project_id, name, min(created_at) as first_def from symbols where project_id is not null and name is not null group by 1, 2),
judged as (
  select r.*, case when d.name is null then 'missing' when d.first_def > r.indexed_at then 'late' end as state
  from refs r left join defs d on r.project_id = d.project_id and r.name = d.name)"""
_TREE = f"""with recursive {_REFS},
links as (select distinct project_id, name as node, up as parent from judged where state is null or state <> 'missing'),
names as (select project_id, node from links union select project_id, parent from links),
roots as (select n.project_id, n.node from names n left join links l on n.project_id = l.project_id and n.node = l.node where l.node is null),
walk as (
  select project_id, node, node as root, cast(0 as bigint) as depth, node as path from roots
  union all
  select l.project_id, l.node, w.root, w.depth + 1, w.path || '/' || l.node from walk w join links l on l.project_id = w.project_id and l.parent = w.node)
"""

SQL = {
    "p3_found": f"with {_REFS} select call_id, state from judged where state is not null",
    "p3_orphan_periods": f"""with {_REFS} select 'call_graph' as table_name, cast(date_trunc('month', indexed_at) as date) as period, state,
 count(*) as n_refs, count(distinct (project_id, name)) as n_keys from judged where state is not null group by 2, 3""",
    "p3_orphan_keys": f"with {_REFS} select project_id, name, count(*) as refs, min(indexed_at) as first_ref from judged where state = 'missing' group by 1, 2",
    "p4_found": _TREE
    + """select n.project_id, n.node, coalesce(w.root, '') as root, coalesce(w.depth, -1) as depth
from names n left join walk w on n.project_id = w.project_id and n.node = w.node""",
    "p4_paths": _TREE + "select project_id, node, path, depth, root from walk",
    "p4_descendants": f"""with recursive {_REFS},
links as (select distinct project_id, name as node, up as parent from judged where state is null or state <> 'missing'),
names as (select project_id, node from links union select project_id, parent from links),
roots as (select n.project_id, n.node from names n left join links l on n.project_id = l.project_id and n.node = l.node where l.node is null),
walk as (
  select project_id, node, cast([] as varchar[]) as above from roots
  union all
  select l.project_id, l.node, list_append(w.above, w.node) from walk w join links l on l.project_id = w.project_id and l.parent = w.node),
pairs as (select project_id, node, unnest(above) as anc, unnest(range(len(above))) as k, len(above) as n from walk)
select project_id, anc as node, node as descendant, cast(n - k as bigint) as steps from pairs""",
}

SQL["p4_rings"] = f"""with recursive {_REFS},
links as (select distinct project_id, name as node, up as parent from judged where state is null or state <> 'missing'),
names as (select project_id, node from links union select project_id, parent from links),
roots as (select n.project_id, n.node from names n left join links l on n.project_id = l.project_id and n.node = l.node where l.node is null),
walk as (select project_id, node from roots union all select l.project_id, l.node from walk w join links l on l.project_id = w.project_id and l.parent = w.node),
rest as (select l.* from links l left join walk w on w.project_id = l.project_id and w.node = l.node where w.node is null),
reach as (select project_id, node, parent as up from rest union select r.project_id, r.node, l.parent from reach r join rest l on l.project_id = r.project_id and l.node = r.up),
on_ring as (select project_id, node from reach where node = up)
select r.project_id, r.node, min(r.up) as ring, count(*) as ring_size from reach r join on_ring o on o.project_id = r.project_id and o.node = r.node group by 1, 2"""
