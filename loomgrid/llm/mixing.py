"""Mixing sources to target weights, by entropy balancing.

Each document gets a rate, its expected number of copies.  Among all rates that
give every source its target number of tokens, the balance takes those closest
to one copy each in relative entropy; they are exponentially tilted by the
document's tokens, ``min(cap, exp(lambda * tokens / mean))``, with one multiplier
a source.  The multipliers solve the convex dual by Newton steps, safeguarded by
bisection; every step is one distributed aggregation over the counts of
documents by (source, tokens), which say all that the dual needs.  The rates are
then rounded into whole copies so that the sums stay: within a source, documents
are spread over buckets by hash and rounded systematically along their tokens,
so no bucket is off by more than about one document.

The total is the largest that all sources can serve within their caps, or as
asked for; a source that cannot reach its part gives all copies it may.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.workspace import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of one rounding bucket, on average.
BUCKET = 4000
#: Steps after which a dual that still does not converge is an error; bisection alone needs about 100.
STEPS = 250

_loaded: dict[tuple[str, str], object] = {}


def load_tokenizer(path: str = TOKENIZER, pattern: str = PATTERN):
    """A tiktoken encoding from a file of ranks, kept for the worker's life."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def clean_source(c):
    """One spelling of a source: lower case, inner separators as underscores; null for blanks."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_")
    return F.when(s != "", s)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens) of every document, over whole texts; null texts have 0 tokens, no spelling of a source is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_tokenizer(tokenizer, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_source(F.col("source")).alias("source"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, source string, tokens long")


@dataclass
class Balance:
    """lam: per source the multiplier, None where everything goes in at its cap."""

    total: float
    goal: dict[str, float]
    lam: dict[str, float | None]
    mean: dict[str, float]
    cap: dict[str, int]
    share: dict[str, float]
    docs: dict[str, int]


def solve(counts: DataFrame, targets: DataFrame, ws: Workspace, total_tokens: float | None = None, tol: float = 1e-9) -> Balance:
    """Solve the dual. ``targets`` is a configuration table, one row a source; the dual has as many unknowns."""
    spark = counts.sparkSession
    tg = {r[0]: (float(r[1]), int(r[2])) for r in targets.groupBy(clean_source(F.col("source")).alias("source")).agg(F.sum("target_share"), F.max("max_repeats")).where("source is not null").collect() if r[1] and r[1] > 0 and r[2] > 0}
    known = spark.createDataFrame([(s,) for s in tg], "source string")
    # One row for each source and token count; the dual needs nothing else of the documents.
    cells = counts.where("tokens > 0").join(F.broadcast(known), "source", "left_semi").groupBy("source", "tokens").agg(F.count("*").alias("n"))
    cells = ws.write(cells, "cells")
    have = {r[0]: (float(r[1]), float(r[2])) for r in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")), F.sum("n")).collect()}
    sure = sum(tg[s][0] for s in have)
    share = {s: tg[s][0] / sure for s in have}
    cap = {s: tg[s][1] for s in have}
    most = min((cap[s] * have[s][0] / share[s] for s in have), default=0.0)
    total = float(total_tokens) if total_tokens else most
    goal = {s: share[s] * total for s in have}
    mean = {s: have[s][0] / have[s][1] for s in have}
    lam: dict[str, float | None] = {}
    work = {}
    for s in have:
        if goal[s] >= cap[s] * have[s][0] * (1 - 1e-9):
            lam[s] = None
        else:
            work[s] = [0.0, -math.inf, math.inf]  # multiplier, bracket: the sum of rates rises with the multiplier from 0 to all caps
    for _ in range(STEPS):
        if not work:
            break
        at = spark.createDataFrame([(s, v[0], mean[s], float(cap[s])) for s, v in work.items()], "source string, lam double, mean double, cap double")
        z = F.col("tokens") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
        below = tilt < F.col("cap")
        mass = F.col("n") * F.col("tokens")
        sums = cells.join(F.broadcast(at), "source").groupBy("source").agg(F.sum(mass * F.least(tilt, F.col("cap"))).alias("g"), F.sum(F.when(below, mass * z * tilt).otherwise(0.0)).alias("h"))
        for s, g, h in sums.collect():
            v = work[s]
            off = g - goal[s]
            if abs(off) <= tol * goal[s] or v[2] - v[1] <= 1e-13 * max(1.0, abs(v[0])):
                lam[s] = v[0]
                del work[s]
                continue
            v[1 if off < 0 else 2] = v[0]
            step = v[0] - off / h if h > 0 else float("nan")
            # Beyond a bound that is not known yet the multiplier doubles; between two bounds it halves.
            if math.isinf(v[1]):
                inner = 2 * v[0] - 1 if v[0] < 0 else v[0] - 1
                v[0] = step if inner <= step < v[2] else inner
            elif math.isinf(v[2]):
                inner = 2 * v[0] + 1 if v[0] > 0 else v[0] + 1
                v[0] = step if v[1] < step <= inner else inner
            else:
                v[0] = step if v[1] < step < v[2] else (v[1] + v[2]) / 2
    if work:
        raise RuntimeError(f"the balance does not converge for {sorted(work)}")
    return Balance(total, goal, lam, mean, cap, share, {s: int(v[1]) for s, v in have.items()})


def mix(counts: DataFrame, targets: DataFrame, ws: Workspace | None = None, total_tokens: float | None = None) -> tuple[DataFrame, Balance]:
    """(doc_id, source, tokens, rate, copies) of every document of a targeted source, and the balance.

    Documents without a target or without tokens are no part of the mix.  No
    document gets more than its source's max_repeats copies.
    """
    spark = counts.sparkSession
    ws = ws or Workspace(spark, "mixing")
    counts = ws.write(counts, "counts")
    bal = solve(counts, targets, ws, total_tokens)
    rows = [(s, bal.lam[s], bal.mean[s], float(bal.cap[s]), max(1, -(-bal.docs[s] // BUCKET))) for s in bal.lam]
    at = spark.createDataFrame(rows, "source string, lam double, mean double, cap double, buckets long")
    d = counts.where("tokens > 0").join(F.broadcast(at), "source")
    rate = F.when(F.col("lam").isNull(), F.col("cap")).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(700.0))), F.col("cap")))
    d = d.withColumn("rate", rate).withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    whole = F.floor("rate")
    frac = F.col("rate") - whole
    w = W.partitionBy("source", "_b").orderBy("tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source", "_b"), F.lit(1 << 20)) / float(1 << 20)
    d = d.withColumn("_f", frac).withColumn("_c", F.sum("_f").over(w) + start)
    extra = F.floor(F.col("_c")) - F.floor(F.greatest(F.col("_c") - F.col("_f"), F.lit(0.0)))
    copies = F.least(whole + extra, F.col("cap")).cast("int")
    return d.select("doc_id", "source", "tokens", "rate", copies.alias("copies")), bal


def shares(mixed: DataFrame, bal: Balance, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_copies, tokens, reached_share) of every target, reached or not."""
    got = mixed.where("copies > 0").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    t = targets.groupBy(clean_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = got.agg(F.sum("tokens").alias("_total"))
    j = t.join(got, "source", "left").join(F.broadcast(total))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select("source", "target_share", "max_repeats", z("n_docs"), z("n_copies"), z("tokens"), F.coalesce(F.col("tokens") / F.col("_total"), F.lit(0.0)).alias("reached_share"))
