"""Code tokens, query terms and hashing embeddings.

Query-side helpers are plain Python on short strings; what runs over tables is
either a column expression or an Arrow UDF over whole batches.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dimensions, token bound, seed and prime of the hashing embedding, punctuation without meaning.
EMBED_DIM, MAX_TOKENS = 256, 512
HASH_SEED, FNV_PRIME = 0xC07AC0DEC0DEC0DE, 0x100000001B3
STOP_PUNCTUATION = set("(){}[],;.:'\"`")
_TOKEN = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)|([0-9]+(?:\.[0-9]*)?)|((?:(?![A-Za-z0-9\s]).)+)", re.S)


def camel_words(s: str) -> list[str]:
    """Words of a camel-case name; acronyms stay together and an underscore belongs to its word; an unsplit name is its own word."""
    if not s:
        return []
    cuts = [m.start() for m in re.finditer(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=.)(?=[A-Z][^\W\d_A-Z])", s)]
    return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True) if a < b] or [s]


def camel_parts(c: Column | str) -> Column:
    """``camel_words`` of a column; null stays null, an empty name has no words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, r"(?<=[\p{L}&&[^A-Z]])(?=[A-Z])|(?<=.)(?=[A-Z][\p{L}&&[^A-Z]])"), lambda x: x != "")


def fts_query(text: str) -> str:
    """The full-text expression of a search box: each token quoted, with its camel-case words as alternatives."""
    parts = []
    for raw in text.split():
        t = "".join(c for c in raw if c.isalnum() or c in "_:")
        if t:
            w = camel_words(t)
            parts.append(" OR ".join(f'"{x}"' for x in ([t, *w] if len(w) > 1 else [t])))
    return " ".join(parts)


def query_groups(text: str) -> list[list[str]]:
    """The expression as a disjunction of conjunctions of lower-case terms; AND (a blank) binds tighter than OR.

    A token that the index would split at underscores or colons is a conjunction of its pieces.
    """
    out = []
    for clause in fts_query(text).split(" OR "):
        terms = [t for q in re.findall(r'"([^"]+)"', clause) for t in re.findall(r"[^\W_]+", q.lower())]
        if terms:
            out.append(list(dict.fromkeys(terms)))
    return out


def terms(c: Column | str) -> Column:
    """Lower-case letter and digit runs of a text, as the index splits it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def split_identifier(w: str) -> list[str]:
    """Parts of a camel- or snake-case identifier."""
    out = []
    for piece in w.split("_"):
        if piece:
            cuts = [m.start() for m in re.finditer(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", piece)]
            out += [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]
    return out


def code_tokens(code: str | None) -> dict[str, int]:
    """Token counts of code: identifier parts of two letters or more, numbers in classes, operator runs; the MAX_TOKENS most frequent, ties by token."""
    n: Counter[str] = Counter()
    for word, number, op in _TOKEN.findall(code or ""):
        if word:
            n.update(p.lower() for p in split_identifier(word) if len(p) > 1)
        elif number:
            n["<FLOAT>" if "." in number else "<NUM>" if len(number) > 4 else number] += 1
        elif op not in STOP_PUNCTUATION:
            n[op] += 1
    if len(n) <= MAX_TOKENS:
        return dict(n)
    return dict(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:MAX_TOKENS])


_vectors: dict[str, np.ndarray] = {}


def token_vector(token: str) -> np.ndarray:
    """The hashing vector of a token: one seeded FNV-1a hash for each dimension, all dimensions at once."""
    v = _vectors.get(token)
    if v is None:
        with np.errstate(over="ignore"):
            h = np.uint64(HASH_SEED) + np.arange(EMBED_DIM, dtype=np.uint64)
            for b in token.encode():
                h = (h ^ np.uint64(b)) * np.uint64(FNV_PRIME)
        v = np.clip((h >> np.uint64(33)).astype(np.float64) / (2**31 - 1), -1.0, 1.0)
        if len(_vectors) < 50_000:
            _vectors[token] = v
    return v


def embed(tokens: dict[str, int]) -> np.ndarray:
    """Unit vector of weighted token vectors; zero for no tokens."""
    v = np.zeros(EMBED_DIM)
    for t in sorted(tokens):
        v += tokens[t] * token_vector(t)
    n = np.sqrt((v * v).sum())
    return v / n if n > 0 else v


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def code_tokens_udf(s: pd.Series) -> pd.Series:
    return s.map(code_tokens)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: embed(code_tokens(x)).astype(np.float32).tolist())


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
