"""Packing files into bundles of bounded size, in order.

Whether a file opens a bundle depends on all before it, which no window frame
expresses; the fold runs per packing job (a project, a request) over its sizes
only, never over contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.paths import FAMILY_ORDER, directory, family

# Bytes and files of a bundle, share at which a change of kind opens a new one, bytes added for each file.
MAX_CHARS, MAX_FILES, SPLIT_AT, OVERHEAD = 60_000, 20, 0.75, 20


def costs(files: DataFrame, path: str = "path", content: str | None = "content", size: str | None = None) -> DataFrame:
    """Add cost: bytes of content and path and an overhead."""
    n = F.col(size) if size else F.octet_length(content)
    return files.withColumn("cost", (F.coalesce(n, F.lit(0)) + F.octet_length(path) + OVERHEAD).cast("long"))


class Folder:
    """The state of one job's packing: the open bundle and its load.

    ``kind`` lets a change of kind split a bundle of two files or more that is
    nearly full; ``part`` starts a new bundle whenever it changes.
    """

    def __init__(self, max_chars: int, max_files: int):
        self.max_chars, self.max_files = max_chars, max_files
        self.bundle, self.total, self.n, self.kind, self.part = 0, 0, 0, None, None

    def add(self, cost: int, kind=None, part=None) -> int:
        full = self.n >= self.max_files or (self.n > 0 and self.total + cost > self.max_chars)
        turn = kind is not None and self.n >= 2 and kind != self.kind and self.total + cost > int(self.max_chars * SPLIT_AT)
        if self.n and (full or turn or part != self.part):
            self.bundle, self.total, self.n = self.bundle + 1, 0, 0
        self.total, self.n, self.kind, self.part = self.total + cost, self.n + 1, kind, part
        return self.bundle


def fold(cost: list[int], kind: list | None, max_chars: int, max_files: int) -> list[int]:
    """Bundle number of each file in order."""
    f = Folder(max_chars, max_files)
    return [f.add(c, kind[i] if kind is not None else None) for i, c in enumerate(cost)]


def pack(files: DataFrame, job: str, strategy: str = "flat", by: str | None = None, order: str = "path", max_chars: int = MAX_CHARS, max_files: int = MAX_FILES) -> DataFrame:
    """(job, path, bundle, cost): bundles of each job.

    flat: in the given order.  smart: by directory, family and path.  ``by``
    'directory' or 'language': separately for each value, numbered by its order.
    Rows arrive sorted by job and order and are folded as they stream by; a task
    holds one batch and one open bundle, however many files a job has.
    """
    rank = None
    for i, f in enumerate(FAMILY_ORDER):
        rank = F.when(F.col("_fam") == f, i) if rank is None else rank.when(F.col("_fam") == f, i)
    d = files.select(job, "path", "cost", F.col(order).alias("_o"), directory("path").alias("_dir"), family("path").alias("_fam")).withColumn("_rank", rank)
    kind = F.concat_ws("\u0001", "_dir", "_fam") if strategy == "smart" and not by else F.lit(None).cast("string")
    part = F.col("_dir") if by == "directory" else F.col("_fam") if by else F.lit("")
    keys = [part, "_o"] if by else ["_dir", "_rank", "path"] if strategy == "smart" else ["_o"]
    d = d.select(job, "path", "cost", kind.alias("_kind"), part.alias("_part"), *[F.col(k).alias(f"_s{i}") if isinstance(k, str) else k.alias(f"_s{i}") for i, k in enumerate(keys)])
    d = d.repartition(job).sortWithinPartitions(job, *[f"_s{i}" for i in range(len(keys))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, f = object(), Folder(max_chars, max_files)
        for b in batches:
            out = []
            for j, c, k, p in zip(b[job], b["cost"], b["_kind"], b["_part"], strict=True):
                if j != now:
                    now, f = j, Folder(max_chars, max_files)
                out.append(f.add(c, k, p))
            yield pd.DataFrame({job: b[job], "path": b["path"], "bundle": out, "cost": b["cost"]})

    kind_of = dict(files.dtypes)[job]
    return d.mapInPandas(run, f"{job} {kind_of}, path string, bundle int, cost long")


def merge_small(packed: DataFrame, job: str, least: int, max_chars: int = MAX_CHARS, max_files: int = MAX_FILES) -> DataFrame:
    """Join neighbouring bundles that both have fewer than ``least`` files, while the limits hold."""
    kind = dict(packed.dtypes)[job]
    g = packed.groupBy(job, "bundle").agg(F.count("*").alias("n"), F.sum("cost").alias("c")).repartition(job).sortWithinPartitions(job, "bundle")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # As in ``pack``: bundles stream by in order, and only the open one is held.
        now, cur, n, c = object(), -1, 0, 0
        for p in batches:
            to = []
            for j, m, k in zip(p[job], p["n"], p["c"], strict=True):
                if j != now:
                    now, cur, n, c = j, -1, 0, 0
                if cur >= 0 and n < least and m < least and n + m <= max_files and c + k <= max_chars:
                    n, c = n + m, c + k
                else:
                    cur, n, c = cur + 1, m, k
                to.append(cur)
            yield pd.DataFrame({job: p[job], "bundle": p["bundle"], "merged": to})

    m = g.select(job, "bundle", "n", "c").mapInPandas(run, f"{job} {kind}, bundle int, merged int")
    return packed.join(m, [job, "bundle"]).select(job, "path", F.col("merged").alias("bundle"), "cost")


def bundle_stats(packed: DataFrame, job: str) -> DataFrame:
    """(job, bundles, files, chars, avg_files, avg_chars, single_file_bundles)."""
    b = packed.groupBy(job, "bundle").agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
    return b.groupBy(job).agg(F.count("*").alias("bundles"), F.sum("n").alias("files"), F.sum("c").alias("chars"), F.avg("n").alias("avg_files"), F.avg("c").alias("avg_chars"), F.count_if(F.col("n") == 1).alias("single_file_bundles"))
