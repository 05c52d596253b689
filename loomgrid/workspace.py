"""Written intermediate tables: the engine's only way of cutting lineage.

Iterative operators (pointer doubling, frontier walks, Newton steps) need each
round to be a leaf of the next plan.  A table in a folder that all executors
share survives the loss of any executor, is columnar, and is computed once;
``localCheckpoint`` has none of these properties and is never used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}


def _checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves a local master;
    a cluster without the setting is refused, since a folder on one machine
    would not be seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        _own[app] = tempfile.mkdtemp(prefix="loomgrid-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def kept_folder(spark: SparkSession, label: str, *inputs: str) -> tuple[str, bool]:
    """A folder for what is derived once from the files of ``inputs``, and whether it is complete.

    The folder is named after the paths, sizes and times of all input files, so what
    was derived from other contents is never taken for it.  Whoever fills it marks it
    by ``mark_complete``; until then it counts as missing.
    """
    import hashlib

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for name in inputs:
        p = jvm.org.apache.hadoop.fs.Path(name)
        it = p.getFileSystem(conf).listFiles(p, True)
        while it.hasNext():
            f = it.next()
            seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    key = hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]
    folder = f"{_checkpoint_root(spark)}/kept-{label}-{key}"
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/complete")
    return folder, p.getFileSystem(conf).exists(p)


def mark_complete(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/complete")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


class Workspace:
    """Tables written by one operator call, dropped one by one as they are superseded."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._live: dict[str, str] = {}
        atexit.register(self.close)

    def write(self, df: DataFrame, label: str, replaces: str | None = None) -> DataFrame:
        """Write df and read it back; ``replaces`` names an older table that no later plan reads."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.mode("overwrite").option("compression", "lz4").parquet(path)
        if replaces and replaces in self._live:
            self._delete(self._live.pop(replaces))
        self._live[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def write_measured(self, df: DataFrame, label: str, measure: Column, replaces: str | None = None) -> tuple[DataFrame, int]:
        """Write df and measure it on the way: the table, and the value of one aggregate over its rows."""
        seen = Observation()
        return self.write(df.observe(seen, measure.alias("m")), label, replaces), seen.get["m"] or 0

    def drop(self, label: str) -> None:
        if label in self._live:
            self._delete(self._live.pop(label))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Drop everything; registered for the end of the process."""
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
