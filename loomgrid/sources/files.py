"""Source trees, snapshots, vocabularies and caches as tables."""

from __future__ import annotations

import os
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.paths import ignored, language

# Files a scan takes by ending, its size bound in bytes, marks of a project root, folders a watch skips.
SCAN_ENDINGS = "rs py pyi ts tsx js jsx mjs cjs go java kt kts c cpp cc cxx h hpp hxx rb php swift scala r sql sh bash zsh toml yaml yml json html css scss dart svelte lua".split()
MAX_BYTES = 200_000
ROOT_MARKS = [".git", "Cargo.toml", "package.json", "pyproject.toml"]
WATCH_SKIPS = ["node_modules", "target"]
BAD_REF = re.compile(r"[;&|`$<>\\\n\r'\"(){}\[\]!*?~ ]|\.\.(?!\.)|^-")


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob with ``*``, ``**`` and ``?``."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return "^" + out + "$"


def ignore_regexes(text: str) -> list[str]:
    """Regular expressions of an ignore file's patterns, relative to its folder; comments, blanks and negations give none."""
    out = []
    for raw in text.splitlines():
        p = raw.strip()
        if not p or p[0] in "#!":
            continue
        body = glob_regex(p.strip("/"))[1:-1]
        out.append(("^" if p.startswith("/") or "/" in p.strip("/") else "(?:^|/)") + body + ("/" if p.endswith("/") else "(?:/|$)"))
    return out


def _tree(spark: SparkSession, root: str) -> DataFrame:
    base = os.path.abspath(root).rstrip("/")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    return d.select(rel.alias("path"), "modificationTime", "length", "content")


def walk_project(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, language, fingerprint, content) of a tree's source files for indexing.

    Hidden paths, ignored ones, unknown languages and plain text are left out, and
    so is content that is no UTF-8.  The size filter of the listing prunes before
    any content is read.
    """
    d = _tree(spark, root).where(~F.col("path").rlike(r"(?:^|/)\.[^/]"))
    for r in ignore or []:
        d = d.where(~F.col("path").rlike(r))
    d = d.withColumn("language", language("path")).where(~F.col("language").isin("unknown", "image", "document", "lock"))
    text = F.expr("try_validate_utf8(cast(content as string))")
    fp = F.concat_ws(":", F.unix_timestamp("modificationTime").cast("string"), F.col("length").cast("string"))
    return d.select("path", "language", fp.alias("fingerprint"), text.alias("content")).where("content is not null")


def walk_scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """(path, content, lines) for a scan: globs, allowed endings or none at all, not blank, at most MAX_BYTES."""
    d = _tree(spark, root).where(F.col("length") <= MAX_BYTES).where(~F.col("path").rlike(r"(?:^|/)\.[^/]"))
    name = F.substring_index("path", "/", -1)
    d = d.where(~name.contains(".") | F.lower(F.substring_index(name, ".", -1)).isin(SCAN_ENDINGS + (extra or [])))
    if include:
        d = d.where(F.col("path").rlike("|".join(glob_regex(p) for p in include)))
    for p in exclude or []:
        d = d.where(~F.col("path").rlike(glob_regex(p)))
    t = d.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("content")).where(F.col("content").rlike(r"\S"))
    return t.withColumn("lines", F.size(F.split(F.regexp_replace("content", r"\n$", ""), "\n")))


# Endings of files in which callers are looked for, and how many files at most.
CALLER_ENDINGS, CALLER_FILES = "rs py ts tsx js jsx go java kt dart c cpp svelte".split(), 400


def walk_callers(spark: SparkSession, root: str, names: list[str], ignore: list[str] | None = None, most: int | None = CALLER_FILES) -> DataFrame:
    """(path, line, name, content): lines of a tree that call one of the names, for when there is no index to ask.

    A call is the name before an opening bracket, with no letter before it and no word
    that defines it.  The first ``most`` files by path are read; None reads all.
    """
    d = _tree(spark, root).where((F.col("length") <= MAX_BYTES) & ~F.col("path").rlike(r"(?:^|/)\.[^/]"))
    d = d.where(F.lower(F.substring_index("path", ".", -1)).isin(CALLER_ENDINGS))
    if ignore:
        d = d.where(~ignored("path", ignore))
    if most is not None:
        d = d.orderBy("path").limit(most)
    names = sorted({n for n in names if n})
    word = "|".join(re.escape(n) for n in names) or "(?!)"
    lines = d.select("path", F.posexplode(F.split(F.expr("try_validate_utf8(cast(content as string))"), "\n")).alias("_p", "content"))
    called = F.regexp_extract("content", rf"(?<![\w$])({word})\s*\(", 1)
    defines = F.col("content").rlike(rf"\b(?:fn|func|function|def|class)\s+(?:\([^)]*\)\s*)?(?:{word})\s*\(")
    return lines.select("path", (F.col("_p") + 1).alias("line"), called.alias("name"), "content").where((F.col("name") != "") & ~defines)


def project_root(start: str) -> str | None:
    """The nearest folder upward that holds a mark of a project root."""
    p = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(p, m)) for m in ROOT_MARKS):
            return p
        if os.path.dirname(p) == p:
            return None
        p = os.path.dirname(p)


def valid_ref(ref: str) -> bool:
    """Whether a revision name is safe to hand on: not empty, no option, no shell characters, no ``..`` range."""
    return bool(ref) and not BAD_REF.search(ref)


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, text) of diff files, each read whole; the id is a hash of the path."""
    d = spark.read.option("wholetext", "true").text(path)
    return d.select(F.xxhash64(F.col("_metadata.file_path")).alias("diff_id"), F.col("value").alias("text"))


SNAPSHOT = "timestamp string, commit string, branch string, files_reviewed long, lines_reviewed long, findings map<string,long>, categories map<string,long>, quality_score double, gate_status string, duration_ms long"


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Debt snapshots of a folder of JSON files, malformed ones skipped; created_at from either timestamp form."""
    d = spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").option("multiLine", "true").json(folder)
    at = F.coalesce(F.try_to_timestamp(F.col("timestamp")), F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd HH:mm:ss")))
    return d.withColumn("created_at", at).where("created_at is not null")


def write_snapshots(snaps: DataFrame, folder: str) -> None:
    snaps.write.mode("append").json(folder)


def read_vocabulary(vectors: bytes, names: list[str]) -> tuple[dict[str, int], list[list[float]]]:
    """(row by lower-case token, rows) of a packed vocabulary: header of two 32-bit counts, then signed bytes of 127ths; the first of equal tokens wins."""
    n, dim = struct.unpack_from("<II", vectors)
    if len(vectors) != 8 + n * dim:
        raise ValueError(f"{len(vectors)} bytes for {n} vectors of {dim}")
    body = struct.unpack_from(f"{n * dim}b", vectors, 8)
    rows = [[x / 127 for x in body[i * dim : (i + 1) * dim]] for i in range(n)]
    index: dict[str, int] = {}
    for i, t in enumerate(names[:n]):
        index.setdefault(t.lower(), i)
    return index, rows


def pretrained_embeddings(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, vec): unit sums of token vectors weighted by counts, from tokens (id, token, n) and vocab (token, vec); unknown tokens are skipped."""
    d = tokens.join(vocab, "token").select("id", "n", F.posexplode("vec").alias("i", "x"))
    s = d.groupBy("id", "i").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
    v = s.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("id", F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).cast("array<float>").alias("vec"))
