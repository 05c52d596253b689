"""Joins that hold up when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it owns more than one row in HOT_SHARE of all rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: ... and at least this many rows, below which one task takes a key without trouble.
HOT_ROWS = 200_000


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small`` (one row per key), whose ``weight`` counts the key's rows in ``big``.

    Hot keys (more than max(HOT_ROWS, total / HOT_SHARE) rows) never meet in one
    task: their rows of ``small`` are broadcast, and the bound on the broadcast
    is proven, since weights add up to ``total``: at most HOT_SHARE rows.  All
    other keys go through an ordinary shuffle join, in which hot rows of ``big``
    are spread by a random key.  ``how`` is inner or left; null keys match nothing.
    """
    cols = [c for c in small.columns if c not in keys and c != weight]
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if total <= HOT_ROWS:
        return big.join(small.drop(weight), keys, how)
    hot = small.where(F.col(weight) > limit).select(*keys, F.struct(F.lit(True).alias("_is"), *cols).alias("_hot"))
    cold = small.where(F.col(weight) <= limit).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(F.lit(True).alias("_is"), *cols).alias("_cold"))
    tagged = big.join(F.broadcast(hot), keys, "left")
    # A matched hot row gets a null key: the shuffle hashes it by its salt alone and it finds no partner there.
    tagged = tagged.select("*", *[F.when(F.col("_hot").isNull(), F.col(k)).alias(f"_j_{k}") for k in keys])
    cond = None
    for k in keys:
        c = F.col(f"_j_{k}") == F.col(f"_k_{k}")
        cond = c if cond is None else cond & c
    out = tagged.join(cold, cond, "left")
    if how == "inner":
        out = out.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*big.columns, *[got[c].alias(c) for c in cols])
