"""Severities, categories and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["critical", "major", "minor", "info"]
# Score penalties out of 10 and out of 100, hours of debt.
PENALTY_10 = {"critical": 2.0, "major": 1.0, "minor": 0.3, "info": 0.1}
PENALTY_100 = {"critical": 20.0, "major": 10.0, "minor": 3.0, "info": 1.0}
HOURS = {"critical": 2.0, "major": 1.0, "minor": 0.25, "info": 0.1}
# The eight categories and their spellings.
CATEGORIES: dict[str, list[str]] = {
    "security": ["security", "vulnerability", "injection", "xss", "csrf", "sqli"],
    "bug_risk": ["bug", "bugs", "logic", "correctness", "bug_risk"],
    "performance": ["performance", "perf", "memory", "speed", "n+1"],
    "error_handling": ["error", "panic", "unwrap", "error_handling"],
    "complexity": ["complexity", "cognitive", "complex"],
    "style": ["style", "naming", "formatting"],
    "best_practice": ["best_practice", "best-practice", "bestpractice"],
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal(c: Column | str) -> Column:
    """One spelling of a severity: lower case, blanks removed."""
    return F.lower(F.trim(_c(c)))


def rank(c: Column | str) -> Column:
    """0 for critical down to 3 for info; null for anything else."""
    s, out = normal(c), None
    for i, name in enumerate(SEVERITIES):
        out = F.when(s == name, i) if out is None else out.when(s == name, i)
    return out.cast("int")


def weigh(c: Column | str, weights: dict[str, float]) -> Column:
    s, out = normal(c), None
    for k, v in weights.items():
        out = F.when(s == k, F.lit(v)) if out is None else out.when(s == k, F.lit(v))
    return out.otherwise(0.0)


def category(c: Column | str) -> Column:
    """One of eight categories; unknown and missing types are 'other'."""
    s, out = F.lower(F.trim(_c(c))), None
    for k, v in CATEGORIES.items():
        out = F.when(s.isin(v), k) if out is None else out.when(s.isin(v), k)
    return out.otherwise("other")


def at_least(c: Column | str, least: str) -> Column:
    """Whether a severity is the given one or worse."""
    return rank(c) <= SEVERITIES.index(least.lower())


def score_10(c: Column | str) -> Column:
    """Aggregate: 10 less the penalties, not below 0."""
    return F.round(F.greatest(F.lit(0.0), 10.0 - F.coalesce(F.sum(weigh(c, PENALTY_10)), F.lit(0.0))), 6)


def score_100(c: Column | str) -> Column:
    """Aggregate: 100 less the penalties, not below 0, as a whole number."""
    return F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.sum(weigh(c, PENALTY_100)), F.lit(0.0))).cast("long")
