"""Full-text, filter, vector and hybrid retrieval.

A corpus is indexed as postings (doc, term, tf) and statistics; N, document
frequencies and the average length are over the whole corpus, and filters apply
after scoring, so a filter changes which documents come out but not their scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.paths import contains_like, like
from loomgrid.functions.text import dot, norm, query_groups, terms

# BM25 and fusion constants.
K1, B, RRF_K = 1.2, 0.75, 60
IDF_FLOOR = 1e-6
LIMIT = 50


def postings(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(doc, term, tf, dl): term counts and length of each document over all text columns; null texts are empty."""
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    d = docs.select(F.col(id_col).alias("doc"), terms(text).alias("_w"))
    d = d.select("doc", F.size("_w").alias("dl"), F.explode("_w").alias("term"))
    return d.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))


def _count(words: Column, term: str) -> Column:
    """How often a term stands in an array of words; array_remove is one generated loop, without a lambda."""
    return F.size(words) - F.size(F.array_remove(words, term))


def bm25(docs: DataFrame, query: str, id_col: str, text_cols: list[str]) -> DataFrame:
    """(doc, score) of all documents that satisfy the query, a disjunction of conjunctions of terms.

    Only the query's terms are exploded: one pass splits each text, keeps the
    counts of a handful of terms, and all statistics come from that pass; no
    posting of another term is ever shuffled.
    """
    groups = query_groups(query)
    asked = list(dict.fromkeys(t for g in groups for t in g))
    if not asked:
        return docs.select(F.col(id_col).alias("doc"), F.lit(0.0).alias("score")).where(F.lit(False))
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    tf = {t: f"_tf{i}" for i, t in enumerate(asked)}
    # One generated row a document: a filter on the counts stops at the generator, so a text is split once and not once for each term.
    counted = F.transform(F.array(terms(text)), lambda w: F.struct(F.size(w).alias("dl"), *[_count(w, t).alias(c) for t, c in tf.items()]))
    w = docs.select(F.col(id_col).alias("doc"), F.explode(counted).alias("_s")).select("doc", "_s.*")
    stats = w.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"), *[F.count_if(F.col(c) > 0).alias(f"_df{c}") for c in tf.values()])
    j = w.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for c in tf.values():
        df = F.col(f"_df{c}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
        score = score + F.when(F.col(c) > 0, idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))).otherwise(0.0)
    match = F.lit(False)
    for g in groups:
        all_ = F.lit(True)
        for t in g:
            all_ = all_ & (F.col(tf[t]) > 0)
        match = match | all_
    return j.where(match).select("doc", score.alias("score"))


def _filters(d: DataFrame, kind: str | None, language: str | None, file_prefix: str | None, project: int | None) -> DataFrame:
    if project is not None:
        d = d.where(F.col("project_id") == project)
    if kind:
        d = d.where(F.col("kind") == kind)
    if language:
        d = d.where(F.col("language") == language)
    if file_prefix:
        d = d.where(like("file", file_prefix + "%"))
    return d


def search(symbols: DataFrame, text: str | None, project: int | None = None, kind: str | None = None, language: str | None = None, file_prefix: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, name, kind, file, line, signature, score): BM25 over name, signature and file.

    Without text, filters alone with score 0; where full text finds nothing, names
    that contain the text, with the kind filter only, and score 1.
    """
    cols = ["id", "name", "kind", "file", "line", "signature"]
    if not text or not text.strip():
        return _filters(symbols, kind, language, file_prefix, project).select(*cols, F.lit(0.0).alias("score")).orderBy("file", "line", "id").limit(limit)
    hit = bm25(symbols, text, "id", ["name", "signature", "file"])
    found = _filters(symbols, kind, language, file_prefix, project).join(hit.withColumnRenamed("doc", "id"), "id").select(*cols, "score")
    found = found.orderBy(F.desc("score"), "id").limit(limit)
    none = found.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    by_like = _filters(symbols, kind, None, None, project).where(contains_like("name", text)).select(*cols, F.lit(1.0).alias("score")).orderBy("file", "line", "id").limit(limit)
    return found.unionByName(by_like.join(F.broadcast(none)).drop("_n"))


def similarity(distance):
    """Similarity of a cosine distance, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "vec", members: DataFrame | None = None) -> DataFrame:
    """(id, similarity) of the k nearest by cosine; exact.

    ``members`` (column id) is joined before the top k, so a filter costs no
    recall.  Vectors of another length or of zero length are no candidates.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.where(F.size(vec_col) == len(query))
    if members is not None:
        d = d.join(members.select(F.col(members.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    v = F.col(vec_col)
    qn = sum(x * x for x in query) ** 0.5
    if qn == 0:
        return d.select(F.col(id_col).alias("id"), F.lit(0.0).alias("similarity")).where(F.lit(False))
    cos = dot(v, q) / (norm(v) * F.lit(qn))
    return d.where(norm(v) > 0).select(F.col(id_col).alias("id"), similarity(1.0 - cos).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def upsert_vectors(old: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """Vectors after an upsert: new rows replace old ones of the same id.

    Of repeated new rows the one written last, by the column ``order``, is kept;
    without an order, and among ties of it, the largest, so the result never depends
    on how rows are spread.  A null order comes first.
    """
    by = F.struct(F.col(order), F.col("vec")) if order else F.struct("vec")
    last = new.groupBy(id_col).agg(F.max(by).alias("_w")).select(id_col, F.col("_w.vec").alias("vec"))
    return old.join(last, id_col, "left_anti").select(id_col, "vec").unionByName(last)


def remove_vectors(old: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    return old.join(gone.select(id_col).distinct(), id_col, "left_anti")


def fuse(ranked: dict[str, DataFrame], limit: int = LIMIT, k: int = RRF_K) -> DataFrame:
    """(id, score, signals): reciprocal-rank fusion of lists with columns id and rank (from 1)."""
    u = None
    for name, d in ranked.items():
        x = d.select("id", "rank", F.lit(name).alias("signal"))
        u = x if u is None else u.unionByName(x)
    g = u.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("signal")).alias("signals"))
    return g.orderBy(F.desc("score"), "id").limit(limit)


def ranked(d: DataFrame, score: str) -> DataFrame:
    """(id, rank) of a list that a limit keeps short."""
    return d.select("id", F.row_number().over(W.orderBy(F.desc(score), "id")).alias("rank"))


def hybrid(symbols: DataFrame, edges: DataFrame, vectors: DataFrame, text: str, query_vector: list[float], project: int | None = None, limit: int = 20) -> DataFrame:
    """Full text, vectors and graph proximity fused: (id, name, kind, file, line, signature, score, signals), best first."""
    from loomgrid.operators.graph import proximity

    limit = min(limit, 50)
    fetch = 2 * limit
    fts = search(symbols, text, project, limit=min(fetch, LIMIT))
    members = symbols.where(F.col("project_id") == project).select("id") if project is not None else None
    vec = knn(vectors, query_vector, fetch, members=members)
    lists = {"fts": ranked(fts, "score"), "vector": ranked(vec, "similarity")}
    top = fts.orderBy(F.desc("score"), "id").select("name").first()
    if top:
        lists["graph"] = proximity(symbols, edges, top[0], project, fetch).select("id", "rank")
    f = fuse(lists, limit)
    return f.join(symbols.select("id", "name", "kind", "file", "line", "signature"), "id").select("id", "name", "kind", "file", "line", "signature", "score", "signals").orderBy(F.desc("score"), "id")
