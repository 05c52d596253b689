"""Session factory with the settings the engine is written for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "loomgrid", cores: int | str | None = None, shuffle: int = 8, extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from the launcher.

    UTC keeps timestamps comparable with the SQL oracles, adaptive execution
    coalesces small shuffles and splits skewed ones at run time.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so their Python workers can import it from wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loomgrid-code-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, True)
    target = f"{folder}/loomgrid_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
