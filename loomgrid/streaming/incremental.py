"""Structured Streaming: incremental indexing, orphan counts kept from deltas, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.operators.references import KEYS, fold_deltas
from loomgrid.sources.files import WATCH_SKIPS


def file_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """New and changed files of a folder as (path, modified, size, content)."""
    d = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return d.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def watched(stream: DataFrame, tracked: DataFrame | None = None, pause: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(path, start, changes): bursts of changes of a file, each as one event once no change followed for the pause.

    Folders that tools fill are left out; with ``tracked`` (path) only those files count.
    """
    d = stream.where(~F.col("path").rlike("(?:^|/)(?:" + "|".join(WATCH_SKIPS) + ")/"))
    if tracked is not None:
        d = d.join(tracked.select("path").distinct(), "path", "left_semi")
    w = d.withWatermark("modified", late).groupBy("path", F.session_window("modified", pause).alias("_w"))
    return w.agg(F.count("*").alias("changes")).select("path", F.col("_w.start").alias("start"), "changes")


#: Buckets of a table kept by a stream, by the hash of its key; one bucket should fit a task.
BUCKETS = 64


def _parts(spark: SparkSession, base: str, batch_id: int) -> dict[int, int]:
    """The version that holds each bucket after a batch; at most BUCKETS entries."""
    if batch_id < 0:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{base}/parts-{batch_id}").collect()}


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def read_kept(spark: SparkSession, base: str, batch_id: int, schema) -> DataFrame:
    """The table at ``base`` as it was after a batch."""
    parts = _parts(spark, base, batch_id)
    paths = [f"{base}/v{v}/bucket={b}" for b, v in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _keep(batch: DataFrame, batch_id: int, base: str, key: list[str], merge) -> None:
    """Merge a batch into the table at ``base``, rewriting only the buckets that hold keys of it.

    A batch that is retried starts from its predecessor's buckets and overwrites its
    own version, so it changes nothing twice; what no batch can start from any more
    is deleted, so cost and disk go with the change and not with the history.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")
    before = _parts(spark, base, batch_id - 1)
    touched = [r[0] for r in batch.select(bucket).distinct().collect()]
    paths = [f"{base}/v{before[b]}/bucket={b}" for b in touched if b in before]
    after = dict(before)
    if touched:
        old = spark.read.schema(batch.schema).parquet(*paths) if paths else None
        new = merge(old, batch).select(*batch.columns).withColumn("bucket", bucket)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/v{batch_id}")
        for b in touched:
            after.pop(b, None)
        after |= {r[0]: batch_id for r in spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{base}/v{batch_id}").select("bucket").distinct().collect()}
    spark.createDataFrame(list(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{base}/parts-{batch_id}")
    if batch_id > 1 and _exists(spark, f"{base}/parts-{batch_id - 2}"):
        for b, v in _parts(spark, base, batch_id - 2).items():
            if before.get(b) != v:
                _delete(spark, f"{base}/v{v}/bucket={b}")
        _delete(spark, f"{base}/parts-{batch_id - 2}")


def versioned_writer(base: str, key: list[str], order: str):
    """A foreachBatch function that keeps a table at ``base`` replaced by key; of repeated keys the last by ``order`` stays, null keys are keys."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        u = batch.withColumn("_new", F.lit(1))
        if old is not None:
            u = u.unionByName(old.withColumn("_new", F.lit(0)))
        rest = [c for c in batch.columns if c not in key]
        return u.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_new", order, F.xxhash64(*rest))).alias("_r")).select(*key, "_r.*")

    return lambda batch, batch_id: _keep(batch, batch_id, base, key, merge)


def orphan_state_writer(base: str):
    """A foreachBatch function that folds reference and existence deltas into the state at ``base``, see ``references.fold_deltas``."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return fold_deltas(batch) if old is None else fold_deltas(batch, old)

    return lambda batch, batch_id: _keep(batch, batch_id, base, KEYS, merge)


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) in fixed windows; with ``late`` a watermark bounds the state."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if late else e
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "7 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if late else e
    return e.groupBy(F.window("at", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str | None = None) -> DataFrame:
    """(user_id, start, n) of bursts of a user's events with no longer pause than the gap."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if late else e
    return e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
