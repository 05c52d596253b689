"""The relations as tables: incremental replacement, pruning and cascades.

Parquet has no update in place, so a change is a new version of the affected
rows: old rows of changed keys go by anti-join, new ones come by union.  The key
of a file is (project_id, path), never the path alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_KEY = ["project_id", "file"]


def changed_files(current: DataFrame, known: DataFrame) -> DataFrame:
    """Files (project_id, path, fingerprint) that are new or whose fingerprint differs from the newest known one."""
    last = known.groupBy("project_id", "path").agg(F.max_by("fingerprint", "last_indexed").alias("_known"))
    j = current.join(last, ["project_id", "path"], "left")
    return j.where(~F.col("fingerprint").eqNullSafe(F.col("_known"))).select(*current.columns)


def replace_by_file(old: DataFrame, new: DataFrame, changed: DataFrame, key: list[str] = FILE_KEY) -> DataFrame:
    """The table after re-indexing: rows of changed files are replaced by the new ones, whether or not there are any."""
    c = changed.select(*key).distinct()
    return old.join(c, key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old rows of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def latest_files(files: DataFrame) -> DataFrame:
    """One row for each (project_id, path): the newest."""
    cols = [c for c in files.columns if c not in ("project_id", "path")]
    g = files.groupBy("project_id", "path").agg(F.max(F.struct("last_indexed", *[c for c in cols if c != "last_indexed"])).alias("_r"))
    return g.select("project_id", "path", "_r.*").select(*files.columns)


def prune(tables: dict[str, DataFrame], existing: DataFrame, project: int) -> dict[str, DataFrame]:
    """Drop a project's rows of files that are not in ``existing`` (path), from files and from every dependent table, typed edges included."""
    gone = tables["files"].where(F.col("project_id") == project).join(existing.select("path").distinct(), "path", "left_anti").select("project_id", F.col("path").alias("file")).distinct()
    out = {}
    for name, t in tables.items():
        g = gone.withColumnRenamed("file", "path") if name == "files" else gone
        out[name] = t.join(g, g.columns, "left_anti").select(*t.columns)
    return out


def delete_project(tables: dict[str, DataFrame], project: int) -> dict[str, DataFrame]:
    """Drop a project and what belongs to it."""
    return {n: t.where(F.col("id" if n == "projects" else "project_id") != project) if n == "projects" else t.where(~F.col("project_id").eqNullSafe(F.lit(project))) for n, t in tables.items()}


def rebuild_needed(projects: DataFrame, config_hash: str) -> DataFrame:
    """Projects whose index was built under another configuration."""
    return projects.where(~F.col("index_config_hash").eqNullSafe(F.lit(config_hash))).select("id", "index_config_hash")


def stale_embeddings(symbols: DataFrame, embedded: DataFrame) -> DataFrame:
    """Symbols whose text has no vector yet: (id, text, text_hash); the text is name and signature."""
    text = F.when(F.coalesce(F.col("signature"), F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(" ", "name", "signature"))
    d = symbols.select("id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return d.join(embedded.select("id", "text_hash").distinct(), ["id", "text_hash"], "left_anti")


def index_stats(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, n_symbols, n_files, n_kinds)."""
    s = symbols.groupBy("project_id").agg(F.count("*").alias("n_symbols"), F.countDistinct("kind").alias("n_kinds"))
    f = files.select("project_id", "path").distinct().groupBy("project_id").agg(F.count("*").alias("n_files"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(f, "project_id", "full").select("project_id", z("n_symbols"), z("n_files"), z("n_kinds"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first; missing values count as 'unknown'."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def cached(cache: DataFrame, key: str, now, ttl_minutes: int = 1440) -> DataFrame:
    """The cached answer of a key while it is younger than the time to live."""
    return cache.where((F.col("key") == key) & (F.col("created_at") >= now - F.expr(f"interval {ttl_minutes} minutes")))


def cache_key(*parts) -> F.col:
    """sha256 of the parts, in order, nulls as empty."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def put_cached(cache: DataFrame, new: DataFrame, now, ttl_minutes: int = 1440) -> DataFrame:
    """The cache after answers (key, answer, created_at) came in: the latest of each key, without what has expired."""
    alive = F.col("created_at") >= now - F.expr(f"interval {ttl_minutes} minutes")
    u = cache.select("key", "answer", "created_at").unionByName(new.select("key", "answer", "created_at")).where(alive & F.col("key").isNotNull())
    return u.groupBy("key").agg(F.max(F.struct("created_at", "answer")).alias("_l")).select("key", "_l.answer", "_l.created_at")


def unscanned(files: DataFrame, cache: DataFrame, now, ttl_minutes: int = 1440) -> DataFrame:
    """Files (path, content) that an incremental scan has still to read: no living answer is stored under their content."""
    alive = cache.where(F.col("created_at") >= now - F.expr(f"interval {ttl_minutes} minutes")).select("key").distinct()
    return files.withColumn("key", cache_key(F.col("path"), F.col("content"))).join(alive, "key", "left_anti")
