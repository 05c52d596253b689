"""DuckDB SQL of the text queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_PAIRS = f"""w as (
  select distinct id, unnest({_WORDS.format("concat_ws(' ', title, body, file)")}) as word from review_issues),
n as (select id, count(*) as n from w group by 1),
both_ as (select a.id as id_a, b.id as id_b, count(*) as o from w a join w b on a.word = b.word and a.id < b.id group by 1, 2),
pairs as (
  select id_a, id_b from both_ join n na on na.id = id_a join n nb on nb.id = id_b
  where 17 * o >= 7 * (na.n + nb.n))"""
_LEAKS = f"""iw as (select item_id, suite, {_WORDS.format("passage")} as w from eval_items),
ig as (select item_id, suite, unnest(range(len(w) - 11)) as p, w from iw where len(w) >= 12),
ik as (select distinct item_id, suite, p, array_to_string(w[p + 1 : p + 12], ' ') as k from ig),
dw as (select doc_id, {_WORDS.format("text")} as w from documents),
dg as (select doc_id, unnest(range(len(w) - 11)) as p, w from dw where len(w) >= 12),
dk as (select distinct doc_id, array_to_string(w[p + 1 : p + 12], ' ') as k from dg),
leaks as (select item_id, suite, doc_id, p from ik join dk using (k))"""
_SPANS = """g as (select doc_id, unnest(range(length(text) - 399)) as p, text from documents where length(text) >= 400),
k as (select distinct doc_id, sha256(substr(text, cast(p as int) + 1, 400)) as k from g)"""

SQL: dict[str, str] = {
    "p5_found": f"with {_PAIRS} select id_a, id_b from pairs",
    "p5_classes": f"""with recursive {_PAIRS},
e as (select id_a as a, id_b as b from pairs union all select id_b, id_a from pairs),
reach as (select distinct a as id, a as r from e union select reach.id, e.b from reach join e on e.a = reach.r)
select id, min(r) as class_id, (select count(*) from e where e.a = reach.id) as n_links from reach group by id""",
    "p7_found": f"with {_LEAKS} select distinct item_id, doc_id from leaks",
    "p7_leaked_items": f"""with {_LEAKS} select item_id, suite, count(distinct doc_id) as n_docs, cast(min(p) as int) as leaked_from,
cast(max(p) + 12 as int) as leaked_to from leaks group by 1, 2""",
    "p9_found": f"with {_SPANS} select distinct a.doc_id as doc_a, b.doc_id as doc_b from k a join k b on a.k = b.k and a.doc_id < b.doc_id",
}

SQL["p9_portions"] = f"""with {_SPANS}, kp as (select doc_id, p, sha256(substr(text, cast(p as int) + 1, 400)) as k from g),
many as (select k from k group by k having count(distinct doc_id) > 1), hit as (select distinct doc_id, p from kp where k in (select k from many)),
iv as (select doc_id, least(400, coalesce(lead(p) over (partition by doc_id order by p) - p, 400)) as n from hit), cov as (select doc_id, sum(n) as shared_chars from iv group by 1)
select doc_id, cast(shared_chars as bigint) as shared_chars, cast(length(text) as bigint) as n_chars, shared_chars / length(text) as portion from cov join documents using (doc_id)"""
# Runs of equal windows on one alignment are whole stretches.
SQL["p9_spans"] = f"""with {_SPANS}, kp as (select doc_id, p, sha256(substr(text, cast(p as int) + 1, 400)) as k from g), many as (select k from k group by k having count(distinct doc_id) > 1),
m as (select a.doc_id as doc_a, b.doc_id as doc_b, a.p as pa, b.p as pb from kp a join kp b on a.k = b.k and a.doc_id < b.doc_id where a.k in (select k from many)),
r as (select *, pa - row_number() over (partition by doc_a, doc_b, pa - pb order by pa) as run from m)
select doc_a, doc_b, cast(min(pa) as int) as start_a, cast(min(pb) as int) as start_b, cast(count(*) + 399 as int) as length from r group by doc_a, doc_b, pa - pb, run"""
