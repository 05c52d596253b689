"""The engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters are left to the optimizer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores.

    A small table in one file is one task, whatever is computed on it; where the
    work on a row is heavy, moving the rows first is cheaper.  A table that already
    has enough partitions, as every large one, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)
