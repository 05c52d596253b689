"""Row numbers over a whole table, without a task that holds the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.workspace import Workspace


def numbered(df: DataFrame, order: list[str], name: str = "row_no", ws: Workspace | None = None) -> DataFrame:
    """Add the row's number (from 1) in the given order.

    Rows are cut into ranges of the order and sorted range by range; a number is
    the position in its range plus the rows of the ranges before, and only the
    counts of the ranges (one row a partition) are summed up in order.  The
    ranges are written once, so both passes see the same cut.
    """
    ws = ws or Workspace(df.sparkSession, "numbered")
    r = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    t = ws.write(r, f"ranges-{name}")
    c = t.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_low"))
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    c = c.select("_p", "_low", before.alias("_before"))
    return t.join(F.broadcast(c), "_p").select(*df.columns, (F.col("_before") + F.col("_k") - F.col("_low") + 1).alias(name))
