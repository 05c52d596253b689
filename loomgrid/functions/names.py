"""Column expressions on symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_name(c: Column | str) -> Column:
    """The bare symbol name of a caller or callee.

    Surrounding blanks and one final ``()`` go, then everything up to the last
    ``::``, ``.`` or ``->``.  Null stays null, a blank name becomes ''.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"\(\)$", "")
    return F.regexp_replace(t, r"(?s)^.*(?:::|\.|->)", "")


def not_blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & c.rlike(r"\S")
