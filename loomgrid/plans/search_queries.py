"""Full-text, filter, vector and fused retrieval, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.text import STOP_PUNCTUATION, code_tokens, code_tokens_udf, dot, embed, embed_udf
from loomgrid.operators import search as s
from loomgrid.operators import vectors as v
from loomgrid.operators.symbol_index import LAYOUT, SymbolIndex
from loomgrid.plans import bindings as b
from loomgrid.sources.tables import spread, table
from loomgrid.workspace import kept_folder, mark_complete

P = b.PROJECT
DOC_QUERY = "queue consumer retryPolicy"
QUERY = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
CODE_QUERY = "seal profile"


def bm25_documents(spark, d):
    hit = s.bm25(spread(table(spark, d, "documents").select("doc_id", "text")), DOC_QUERY, "doc_id", ["text"])
    return hit.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def symbol_search(spark, d):
    return s.search(spread(b.symbols(spark, d)), "pub fn src", P).select("id", "name", F.round("score", 6).alias("score"))


def fts_like_fallback(spark, d):
    return s.search(b.symbols(spark, d), "ealM", P)


def filter_search(spark, d):
    return s.search(b.symbols(spark, d), None, P, kind="method", language="rust", file_prefix="src/")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def knn_top10(spark, d):
    return s.knn(_vectors(spark, d), QUERY, 10).select("id", F.round("similarity", 6).alias("similarity"))


def knn_label_members(spark, d):
    v = _vectors(spark, d)
    return s.knn(v, QUERY, 10, members=v.where("label < 3").select("id")).select("id", F.round("similarity", 6).alias("similarity"))


def _asked(spark, d):
    """Every vector whose id is divisible by 50, as a query against all."""
    return _vectors(spark, d).where("id % 50 = 0")


def knn_many(spark, d):
    """The ten nearest of each query vector, exactly."""
    return v.nearest_of_many(_vectors(spark, d), _asked(spark, d), 10).select("query", "id", F.round("similarity", 4).alias("similarity"))


def _index(spark, d):
    folder, done = kept_folder(spark, f"vectors{v.LAYOUT}", f"{d}/embeddings.parquet")
    if done:
        return v.VectorIndex.open(spark, folder)
    ix = v.VectorIndex.build(_vectors(spark, d), folder, len(QUERY))
    mark_complete(spark, folder)
    return ix


def knn_indexed(spark, d):
    """The ten nearest in the stored index."""
    return _index(spark, d).search(QUERY, 10).select("id", F.round("similarity", 6).alias("similarity"))


def knn_recall(spark, d):
    """How many of the ten nearest of each query vector the stored index finds."""
    return v.recall(_index(spark, d).search_many(_asked(spark, d), 10), v.nearest_of_many(_vectors(spark, d), _asked(spark, d), 10))


def rrf_fusion(spark, d):
    v_ = _vectors(spark, d)
    a = s.ranked(s.knn(v_, QUERY, 40), "similarity")
    c = s.ranked(s.knn(v_, [-x for x in QUERY[::-1]], 40), "similarity")
    return s.fuse({"one": a, "two": c}, 20).select("id", F.round("score", 9).alias("score"), F.array_join("signals", ",").alias("signals"))


def _symbol_index(spark, d):
    folder, done = kept_folder(spark, f"symbols{LAYOUT}", f"{d}/symbols.parquet")
    if done:
        return SymbolIndex(spark, folder)
    ix = SymbolIndex.build(spread(b.symbols(spark, d)), folder)
    mark_complete(spark, folder)
    return ix


def hybrid_search(spark, d):
    """Over the stored index, which is built by the first search and kept as long as the symbols stay the same."""
    q = embed(code_tokens(CODE_QUERY)).tolist()
    h = _symbol_index(spark, d).hybrid(b.edges(spark, d), "fn src", q, P, 20)
    return h.select("id", "name", "kind", "file", "line", F.round("score", 9).alias("score"), F.array_join("signals", ",").alias("signals"))


def symbol_search_indexed(spark, d):
    """As ``symbol_search``, from the stored postings."""
    hit = _symbol_index(spark, d).search("pub fn src", P)
    f = spark.createDataFrame(hit, "id long, score double")
    return b.symbols(spark, d).select("id", "name").join(F.broadcast(f), "id").select("id", "name", F.round("score", 6).alias("score"))


def code_token_counts(spark, d):
    t = spread(table(spark, d, "review_issues").select("id", "suggested_fix")).where("suggested_fix is not null").select("id", F.explode(code_tokens_udf("suggested_fix")).alias("token", "n"))
    return t.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))


def embedding_norms(spark, d):
    v = spread(b.symbols(spark, d).select("id", "name", "signature")).select("id", embed_udf(F.concat_ws(" ", "name", "signature")).alias("vec"))
    return v.select("id", F.size("vec").alias("dims"), F.round(F.sqrt(dot(F.col("vec"), F.col("vec"))), 4).alias("norm"))


QUERIES = {f.__name__: f for f in (bm25_documents, symbol_search, fts_like_fallback, filter_search, knn_top10, knn_label_members, knn_many, knn_indexed, knn_recall, rrf_fusion, hybrid_search, symbol_search_indexed, code_token_counts, embedding_norms)}

_TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _bm25(rel: str, key: str, text: str, asked: list[str], match: str, where: str = "") -> str:
    cols = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as t{i}" for i, t in enumerate(asked))
    dfs = ", ".join(f"count(*) filter (where t{i} > 0) as d{i}" for i in range(len(asked)))
    score = " + ".join(f"case when t{i} > 0 then greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avg_dl)) else 0 end" for i in range(len(asked)))
    return f"""w as (select {key}, {_TERMS.format(text)} as w from {rel}), c as (select {key}, len(w) as dl, {cols} from w),
st as (select count(*) as n, avg(dl) as avg_dl, {dfs} from c), hits as (select {key}, {score} as score from c, st where {match})"""


_Q = "[" + ", ".join(f"{x:.17g}::double" for x in QUERY) + "]"
_R = "[" + ", ".join(f"{-x:.17g}::double" for x in QUERY[::-1]) + "]"
_SIM = "least(1.0, greatest(0.0, list_cosine_similarity(embedding::double[], {0})))"

SQL = {
    "bm25_documents": f"with {_bm25('documents', 'doc_id', 'text', ['queue', 'consumer', 'retrypolicy', 'retry', 'policy'], '(t0 > 0 and t1 > 0 and t2 > 0) or t3 > 0 or t4 > 0')} select doc_id, round(score, 6) as score from hits order by round(score, 6) desc, doc_id limit 20",
    "symbol_search": f"with {_bm25('symbols', 'id', "concat_ws(' ', name, signature, file)", ['pub', 'fn', 'src'], 't0 > 0 and t1 > 0 and t2 > 0')} select id, name, round(score, 6) as score from symbols join hits using (id) where project_id = {P} order by score desc, id limit 50",
    "fts_like_fallback": f"select id, name, kind, file, line, signature, 1.0::double as score from symbols where project_id = {P} and name ilike '%ealM%' order by file, line, id limit 50",
    "filter_search": f"select id, name, kind, file, line, signature, 0.0::double as score from symbols where project_id = {P} and kind = 'method' and language = 'rust' and file ilike 'src/%' order by file, line, id limit 50",
    "knn_top10": f"select vec_id as id, round({_SIM.format(_Q)}, 6) as similarity from embeddings order by {_SIM.format(_Q)} desc, vec_id limit 10",
    "knn_label_members": f"select vec_id as id, round({_SIM.format(_Q)}, 6) as similarity from embeddings where label < 3 order by {_SIM.format(_Q)} desc, vec_id limit 10",
    "rrf_fusion": f"""with a as (select vec_id as id, row_number() over (order by {_SIM.format(_Q)} desc, vec_id) as r from embeddings), c as (select vec_id as id, row_number() over (order by {_SIM.format(_R)} desc, vec_id) as r from embeddings),
u as (select id, r, 'one' as s from a where r <= 40 union all select id, r, 'two' from c where r <= 40)
select id, round(sum(1.0 / (60 + r)), 9) as score, string_agg(s, ',' order by s) as signals from u group by id order by sum(1.0 / (60 + r)) desc, id limit 20""",
}
SQL["symbol_search_indexed"] = SQL["symbol_search"]
SQL["knn_many"] = """with q as (select vec_id as query, embedding::double[] as a from embeddings where vec_id % 50 = 0),
s as (select query, vec_id as id, least(1.0, greatest(0.0, list_cosine_similarity(a, embedding::double[]))) as similarity from q, embeddings),
r as (select *, row_number() over (partition by query order by similarity desc, id) as k from s) select query, id, round(similarity, 4) as similarity from r where k <= 10"""
SQL["embedding_norms"] = "select id, cast(256 as int) as dims, cast(1.0 as double) as norm from symbols"

_STOPS = ", ".join("'" + c.replace("'", "''") + "'" for c in sorted(STOP_PUNCTUATION))
SQL["code_token_counts"] = rf"""with t as (select id, unnest(regexp_extract_all(suggested_fix, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]*)?|[^A-Za-z0-9\s]+')) as tok from review_issues where suggested_fix is not null),
u as (select id, unnest(string_split_regex(regexp_replace(regexp_replace(tok, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[ _]')) as p from t where regexp_matches(tok, '^[A-Za-z_]')),
every as (select id, lower(p) as token from u where length(p) > 1
  union all select id, case when contains(tok, '.') then '<FLOAT>' when length(tok) > 4 then '<NUM>' else tok end from t where regexp_matches(tok, '^[0-9]')
  union all select id, tok from t where not regexp_matches(tok, '^[A-Za-z0-9_]') and tok not in ({_STOPS}))
select token, count(*) as n, count(distinct id) as n_texts from every group by 1"""
