"""A stored vector index: inverted lists by nearest centroid, searched in part and ranked exactly.

Centroids are fitted on a bounded sample (``FIT_ROWS``, by a hash of the id); every
vector is put into the list of its nearest one.  A search reads the lists of the
centroids nearest to the query, as many as the sample needed to reach the asked
recall, and ranks what it read by the exact cosine.  Lists are folders of a parquet
table, so a search prunes files, and an upsert rewrites the lists it touches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.operators.search import knn, upsert_vectors

#: Vectors that centroids are fitted on, about; never more than twice as many.
FIT_ROWS = 20_000
#: Lists of an index, at most; below, the square root of the number of vectors.
MOST_LISTS = 1024
#: Queries of a block that is broadcast.
QUERIES = 1000
#: Counts up with every change of the stored tables.
LAYOUT = 1
SCHEMA = "id long, vec array<float>"


def _matrix(c: pa.Array) -> np.ndarray:
    v = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float32) if len(v) else np.zeros((0, 1), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, vec) of the vectors of the asked length that are not zero and hold no null."""
    v = F.col("vec")
    whole = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & whole).select(F.col("id").cast("long").alias("id"), v.cast("array<float>").alias("vec"))


@dataclass
class Lists:
    """Unit centroids and the number of lists that a search reads."""

    centroids: np.ndarray
    probes: int

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """rows x n lists, nearest first"""
        s = x @ self.centroids.T
        return np.argsort(-s, axis=1, kind="stable")[:, :n]


def fit_lists(vectors: DataFrame, dims: int, recall: float = 0.95, k: int = 10, rounds: int = 10) -> Lists:
    """Spherical k-means on a sample, and the fewest lists in which ``recall`` of the sample's k nearest neighbours are found."""
    d = usable(vectors, dims)
    n = d.count()
    cells = 1 << 30
    part = d if n <= FIT_ROWS else d.where(F.pmod(F.xxhash64("id"), F.lit(cells)) < int(cells * FIT_ROWS / n))
    x = _unit(_matrix(part.orderBy("id").limit(2 * FIT_ROWS).toArrow()["vec"])) if n else np.zeros((0, dims), np.float32)
    m = max(1, min(MOST_LISTS, int(n**0.5), len(x)))
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), m, replace=False)] if len(x) else np.ones((1, dims), np.float32)
    for _ in range(rounds if len(x) else 0):
        a = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        some = np.bincount(a, minlength=m) > 0
        c[some] = total[some]
        c = _unit(c)
    lists = Lists(c.astype(np.float32), 1)
    if len(x) > k:
        asked = x[rng.choice(len(x), min(400, len(x)), replace=False)]
        truth = np.argpartition(-(asked @ x.T), k, axis=1)[:, :k]
        own = (x @ c.T).argmax(axis=1)
        order = lists.nearest(asked, m)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(m)[None, :].repeat(len(asked), 0), axis=1)
        need = np.take_along_axis(place, own[truth], axis=1)
        lists.probes = int(np.quantile(need, recall, method="higher")) + 1
    return lists


def assigned(vectors: DataFrame, lists: Lists) -> DataFrame:
    """(id, vec, list) of every usable vector."""
    held = vectors.sparkSession.sparkContext.broadcast(lists.centroids)  # at most MOST_LISTS x dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_unit(_matrix(b.column(1))) @ held.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], names=["id", "vec", "list"])

    return usable(vectors, lists.dims).mapInArrow(run, SCHEMA + ", list int")


class VectorIndex:
    """The index stored in a folder."""

    def __init__(self, spark: SparkSession, folder: str, lists: Lists):
        self.spark, self.folder, self.lists = spark, folder, lists

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, dims: int, recall: float = 0.95) -> VectorIndex:
        ix = cls(vectors.sparkSession, folder, fit_lists(vectors, dims, recall))
        ix._write(assigned(vectors, ix.lists))
        about = [(json.dumps({"probes": ix.lists.probes, "dims": dims, "centroids": ix.lists.centroids.ravel().tolist()}),)]
        ix.spark.createDataFrame(about, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
        return ix

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        return cls(spark, folder, Lists(np.array(about["centroids"], np.float32).reshape(-1, about["dims"]), about["probes"]))

    def _write(self, rows: DataFrame) -> None:
        # A list that holds a large part of all vectors is written by several tasks.
        salted = rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(4)))
        salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.folder}/lists")

    def vectors(self, lists: list[int] | None = None) -> DataFrame:
        d = self.spark.read.schema(SCHEMA + ", list int").parquet(f"{self.folder}/lists")
        return d if lists is None else d.where(F.col("list").isin(lists))

    def search(self, query: list[float], k: int, members: DataFrame | None = None) -> DataFrame:
        """(id, similarity) of the k nearest in the lists near the query; with ``members`` all lists are read, so a filter costs no recall."""
        if len(query) != self.lists.dims:
            return knn(self.vectors(), query, k)
        near = self.lists.nearest(_unit(np.array([query], np.float32)), self.lists.probes)[0].tolist()
        return knn(self.vectors(near if members is None else None), query, k, members=members)

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        """Put vectors in place of those of the same ids; only lists that lose or gain a vector are rewritten."""
        last = upsert_vectors(new.limit(0).select("id", "vec"), new, order=order)
        self._rewrite(assigned(last, self.lists), new.select("id"))

    def remove(self, gone: DataFrame) -> None:
        self._rewrite(None, gone.select("id"))

    def _rewrite(self, put: DataFrame | None, gone: DataFrame) -> None:
        gone = gone.distinct()
        touched = self.vectors().select("id", "list").join(gone, "id", "left_semi").select("list")
        touched = touched if put is None else touched.unionByName(put.select("list"))
        lists = [r[0] for r in touched.distinct().collect()]  # at most MOST_LISTS
        kept = self.vectors(lists).join(gone, "id", "left_anti").select("id", "vec", "list")
        rows = kept if put is None else kept.unionByName(put)
        # The new lists are written aside first, since they are read from the table that they replace.
        aside = f"{self.folder}/aside"
        rows.write.mode("overwrite").parquet(aside)
        rows = self.spark.read.schema(SCHEMA + ", list int").parquet(aside)
        self._write(rows)
        left = {r[0] for r in rows.select("list").distinct().collect()}
        jvm = self.spark._jvm
        for path in [aside, *(f"{self.folder}/lists/list={x}" for x in lists if x not in left)]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.spark.catalog.refreshByPath(f"{self.folder}/lists")

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, id, similarity) of the k nearest of each query vector, in the lists near it."""
        return nearest_of_many(self.vectors(), queries, k, self.lists)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, similarity) of the k nearest of one query, exact, as ``search.knn``; batches are multiplied as matrices and keep their k best, ties included."""
    x = _unit(np.array([query], np.float32))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1)).astype(np.float64)
            sim = np.clip((m * x).sum(axis=1) / np.sqrt((m * m).sum(axis=1)), 0.0, 1.0)
            ok = np.flatnonzero(sim >= np.partition(sim, max(0, len(sim) - k))[max(0, len(sim) - k)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(sim[ok])], names=["id", "similarity"])

    if k <= 0 or not any(query):
        return vectors.select(F.col("id").cast("long").alias("id"), F.lit(0.0).alias("similarity")).where(F.lit(False))
    return usable(vectors, len(query)).mapInArrow(run, "id long, similarity double").orderBy(F.desc("similarity"), "id").limit(k)


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int, lists: Lists | None = None) -> DataFrame:
    """(query, id, similarity) of the k nearest of each query (id, vec); exact, or within the lists near the query where vectors carry a list.

    Queries are broadcast in blocks of QUERIES, one pass over the vectors for each;
    every batch of vectors keeps its k best of each query, so what is shuffled is
    bounded by batches and queries and not by pairs.
    """
    spark = vectors.sparkSession
    q = queries.select(F.col("id").cast("long").alias("id"), "vec")
    first = q.where("vec is not null").limit(1).collect()
    dims = lists.dims if lists else len(first[0].vec) if first else 0
    q = usable(q, dims)
    n = q.count()
    cols = ["id", "vec", *(["list"] if lists else [])]
    src = vectors.select(*cols) if lists else usable(vectors, dims)
    schema = "query long, id long, similarity double"
    blocks = max(1, -(-n // QUERIES))
    out = None
    for i in range(blocks):
        part = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).orderBy("id").toArrow()
        x = _unit(_matrix(part["vec"]).reshape(part.num_rows, -1)) if part.num_rows else np.zeros((0, max(dims, 1)), np.float32)
        near = lists.nearest(x, lists.probes) if lists and len(x) else None
        held = spark.sparkContext.broadcast((part["id"].to_numpy(), x, near))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, x, near = held.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                v, vid = _unit(_matrix(b.column(1))), b.column(0).to_numpy()
                own = b.column(2).to_numpy() if near is not None else None
                for a in range(0, len(ids), 64):
                    s = x[a : a + 64] @ v.T
                    if own is not None:
                        reach = np.zeros((len(s), int(max(near.max(), own.max())) + 1), bool)
                        np.put_along_axis(reach, near[a : a + 64], True, axis=1)
                        s = np.where(reach[:, own], s, -np.inf)
                    m = min(k, s.shape[1])
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    # Ties at the last place are kept, so the smallest id can win.
                    ok = (s >= np.take_along_axis(s, best, axis=1).min(axis=1, keepdims=True)) & np.isfinite(s)
                    r, c = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + r]), pa.array(vid[c]), pa.array(np.clip(s[r, c].astype(np.float64), 0, 1))], names=["query", "id", "similarity"])

        got = src.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    r = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return out.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, n_exact, n_found, recall) of approximate against exact neighbours."""
    hit = found.select("query", "id").withColumn("_hit", F.lit(1))
    j = exact.select("query", "id").join(hit, ["query", "id"], "left")
    g = j.agg(F.countDistinct("query").alias("n_queries"), F.count("*").alias("n_exact"), F.count("_hit").alias("n_found"))
    return g.withColumn("recall", F.coalesce(F.try_divide("n_found", "n_exact"), F.lit(1.0)))
