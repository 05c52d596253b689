"""The pattern language of the call graph: ``A -> *``, ``* -> A``, ``A -> B``, ``A <- *``, ``A <- B``, ``A``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.graph import find_callees, find_callers


@dataclass(frozen=True)
class Pattern:
    source: str
    target: str


def parse(text: str) -> Pattern:
    """Caller and callee of a pattern; ``<-`` turns it round, a bare name asks for its callers, ``*`` stands for any."""
    t = text.strip()
    if not t:
        raise ValueError("empty pattern")
    for arrow, turn in (("->", False), ("<-", True)):
        if arrow in t:
            a, b = (x.strip() for x in t.split(arrow, 1))
            if not a or not b:
                raise ValueError(f"a side of {text!r} is empty")
            return Pattern(b, a) if turn else Pattern(a, b)
    return Pattern("*", t)


def run(pattern: str, calls: DataFrame, symbols: DataFrame, project: int | None = None, limit: int = 50) -> DataFrame:
    """(name, file, line): callers of the target, callees of the source, or the sites where one calls the other.

    With both sides named the filter comes before the limit.  ``* -> *`` lists
    the functions of the project.
    """
    p = parse(pattern)
    if p.source == "*" and p.target == "*":
        d = symbols.where(F.col("kind").isin("function", "procedure"))
        d = d if project is None else d.where(F.col("project_id") == project)
        return d.select("name", "file", "line").distinct().orderBy("file", "line", "name").limit(limit)
    if p.source == "*":
        return find_callers(calls, p.target, project, limit).withColumnRenamed("caller", "name")
    if p.target == "*":
        return find_callees(calls, p.source, project, limit).withColumnRenamed("callee", "name")
    hit = calls.where((F.lower("caller") == p.source.lower()) & (F.lower("callee") == p.target.lower()))
    hit = hit if project is None else hit.where(F.col("project_id") == project)
    return hit.select(F.col("callee").alias("name"), "file", "line").distinct().orderBy("file", "line", "name").limit(limit)
