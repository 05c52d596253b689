"""The stored index of symbols: postings for full text, vectors for meaning, refreshed by what changed.

A search reads postings of its terms and vectors of its project, both laid out so
that files are pruned; texts are split and embedded once, when they are indexed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.text import embed_udf, query_groups
from loomgrid.operators import search as s
from loomgrid.operators.graph import proximity
from loomgrid.operators.store import stale_embeddings
from loomgrid.operators.vectors import nearest

#: Counts up with every change of the stored tables.
LAYOUT = 2
COLS = ["id", "project_id", "name", "kind", "file", "line", "signature", "language"]


class SymbolIndex:
    """Tables ``symbols``, ``postings`` and ``vectors`` in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _put(self, df: DataFrame, name: str, by: str) -> None:
        parts = max(1, self.spark.sparkContext.defaultParallelism)
        df.repartitionByRange(parts, by, "id").sortWithinPartitions(by, "id").write.mode("overwrite").parquet(f"{self.folder}/{name}")

    @classmethod
    def build(cls, symbols: DataFrame, folder: str) -> SymbolIndex:
        """Index all symbols; names and signatures may be null, ids may not."""
        ix = cls(symbols.sparkSession, folder)
        d = symbols.where("id is not null").select(*[F.col(c) for c in COLS])
        ix._put(d, "symbols", "project_id")
        words = s.terms(F.concat_ws(" ", "name", "signature", "file"))
        n, avg_dl = d.agg(F.count("*"), F.avg(F.size(words))).first()
        p = s.postings(d, "id", ["name", "signature", "file"]).withColumnRenamed("doc", "id")
        # What a term adds to a document's score depends on nothing that a query brings, so it is stored.
        df = p.groupBy("term").agg(F.count("*").alias("df"))
        rare = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(s.IDF_FLOOR))
        part = rare * F.col("tf") * (s.K1 + 1) / (F.col("tf") + s.K1 * (1 - s.B + s.B * F.col("dl") / (avg_dl or 1.0)))
        ix._put(p.join(df, "term").select("term", "id", part.alias("part")).join(d.select("id", "project_id"), "id"), "postings", "term")
        todo = stale_embeddings(d, ix.spark.createDataFrame([], "id long, text_hash long"))
        ix._put(cls._embedded(todo).join(d.select("id", "project_id"), "id"), "vectors", "project_id")
        return ix

    @staticmethod
    def _embedded(todo: DataFrame) -> DataFrame:
        cores = todo.sparkSession.sparkContext.defaultParallelism
        return todo.repartition(max(cores, todo.sparkSession.sparkContext.defaultParallelism)).select("id", "text_hash", embed_udf(F.coalesce("text", F.lit(""))).alias("vec"))

    def refresh_vectors(self, symbols: DataFrame) -> int:
        """Embed only symbols whose text has no vector yet, drop those of symbols that are gone; the number embedded."""
        have = self._table("vectors")
        todo = stale_embeddings(symbols, have)
        n = todo.count()
        ids = symbols.select("id", "project_id")
        new = self._embedded(todo).join(ids, "id")
        kept = have.join(todo.select("id"), "id", "left_anti").join(ids.select("id"), "id", "left_semi")
        aside = f"{self.folder}/vectors-new"
        kept.unionByName(new).write.mode("overwrite").parquet(aside)
        self._put(self.spark.read.parquet(aside), "vectors", "project_id")
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(aside)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return n

    def text_hits(self, text: str) -> DataFrame:
        """(id, project_id, score) by BM25 over all symbols, from the postings of the query's terms alone."""
        groups = query_groups(text)
        asked = list(dict.fromkeys(t for g in groups for t in g))
        p = self._table("postings").where(F.col("term").isin(asked or [""]))
        has = {t: F.max((F.col("term") == t).cast("int")).alias(f"_t{i}") for i, t in enumerate(asked)}
        if not asked:
            return p.select("id", "project_id", F.lit(0.0).alias("score")).where(F.lit(False))
        match = F.lit(False)
        for g in groups:
            match = match | F.expr(" and ".join(f"_t{asked.index(t)} > 0" for t in g))
        return p.groupBy("id", "project_id").agg(F.sum("part").alias("score"), *has.values()).where(match).select("id", "project_id", "score")

    def search(self, text: str, project: int | None = None, limit: int = s.LIMIT) -> list[tuple]:
        """(id, score) of the best symbols by full text, at most ``limit``; where there is none, of names that contain the text."""
        hit = self.text_hits(text)
        if project is not None:
            hit = hit.where(F.col("project_id") == project)
        top = [(r.id, r.score) for r in hit.orderBy(F.desc("score"), "id").limit(limit).collect()]
        if top:
            return top
        d = self._table("symbols")
        d = d if project is None else d.where(F.col("project_id") == project)
        return [(r.id, 1.0) for r in d.where(s.contains_like("name", text)).orderBy("file", "line", "id").limit(limit).select("id").collect()]

    def hybrid(self, edges: DataFrame, text: str, query_vector: list[float], project: int | None = None, limit: int = 20) -> DataFrame:
        """Full text, vectors and graph proximity fused, as ``search.hybrid`` gives it.  Lists are cut by their limits before they are ranked."""
        limit = min(limit, 50)
        fetch = 2 * limit
        sym, vec = self._table("symbols"), self._table("vectors")
        if project is not None:
            vec = vec.where(F.col("project_id") == project)
        near = nearest(vec, query_vector, fetch).collect()
        fts = self.search(text, project, min(fetch, s.LIMIT))
        ranks = [("fts", i, k + 1) for k, (i, _) in enumerate(fts)] + [("vector", r.id, k + 1) for k, r in enumerate(near)]
        if fts:
            seed = sym.where(F.col("id") == fts[0][0]).select("name").first()[0]
            ranks += [("graph", r.id, r["rank"]) for r in proximity(sym, edges, seed or "", project, fetch).collect()]
        fused: dict[int, tuple[float, set]] = {}
        for signal, i, rank in ranks:
            a, b = fused.get(i, (0.0, set()))
            fused[i] = (a + 1.0 / (s.RRF_K + rank), b | {signal})
        best = sorted(fused.items(), key=lambda x: (-x[1][0], x[0]))[:limit]
        f = self.spark.createDataFrame([(i, sc, sorted(sg)) for i, (sc, sg) in best], "id long, score double, signals array<string>")
        cols = ["id", "name", "kind", "file", "line", "signature"]
        return sym.where(F.col("id").isin([i for i, _ in best])).select(*cols).join(F.broadcast(f), "id").orderBy(F.desc("score"), "id")
