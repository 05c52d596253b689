"""References to records that do not exist.

State is kept as signed counts per key and time: how often a key is referred to,
and how many records exist under it.  Both come from change deltas, so a batch of
inserts and deletes folds into the state by addition alone, and a deletion takes
its own time out again; keys with positive references and no existence are the
orphan report of the moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.names import bare_name, not_blank
from loomgrid.operators.joins import skew_join
from loomgrid.workspace import Workspace

KEYS = ["project_id", "name"]


def call_references(calls: DataFrame) -> DataFrame:
    """call rows -> (call_id, project_id, name, at); rows without a project or with a blank callee refer to nothing."""
    return calls.where(F.col("project_id").isNotNull() & not_blank("callee")).select(
        F.col("id").alias("call_id"), "project_id", bare_name("callee").alias("name"), F.col("indexed_at").alias("at")
    )


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Signed reference deltas; sign -1 retracts references."""
    return refs.select(*KEYS, F.col("at").cast("timestamp_ntz").alias("at"), F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("defs"))


def existence_deltas(symbols: DataFrame, sign: int = 1) -> DataFrame:
    """Signed existence deltas of symbols; a symbol without project or name defines nothing."""
    s = symbols.where(F.col("project_id").isNotNull() & F.col("name").isNotNull())
    return s.select(*KEYS, F.col("created_at").cast("timestamp_ntz").alias("at"), F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("defs"))


def fold_deltas(*deltas: DataFrame) -> DataFrame:
    """Fold deltas, or an earlier state and deltas, into the state (project_id, name, at, refs, defs).

    One aggregation with map-side partial sums; what adds up to nothing is gone.  A
    row retracted under the time it was added with leaves no trace of it.
    """
    u = deltas[0]
    for d in deltas[1:]:
        u = u.unionByName(d)
    return u.groupBy(*KEYS, "at").agg(F.sum("refs").alias("refs"), F.sum("defs").alias("defs")).where("refs != 0 or defs != 0")


def key_state(deltas: DataFrame) -> DataFrame:
    """(project_id, name, refs, defs, first_def, first_ref) of a state, or of deltas that only add.

    One aggregation with map-side partials, so a key that owns a third of all rows
    reaches its reducer as one row per map task.
    """
    at = lambda n: F.min(F.when(F.col(n) > 0, F.col("at")))
    return deltas.groupBy(*KEYS).agg(F.sum("refs").alias("refs"), F.sum("defs").alias("defs"), at("defs").alias("first_def"), at("refs").alias("first_ref"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys of a state, or of deltas that only add, with positive references and no existing record."""
    return key_state(state).where((F.col("refs") > 0) & (F.col("defs") <= 0))


def late_keys(state: DataFrame) -> DataFrame:
    """Keys whose earliest record came after their earliest reference."""
    return key_state(state).where((F.col("refs") > 0) & (F.col("defs") > 0) & (F.col("first_def") > F.col("first_ref")))


def orphan_references(calls: DataFrame, symbols: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """One row per reference whose record is missing or came late: (call_id, project_id, name, at, state).

    ``missing``: no symbol of that project and exactly that name.  ``late``: the
    earliest such symbol was recorded after the call was indexed.  Only keys that
    hold such a reference are joined back to the calls, by ``skew_join``.
    Empty tables give no rows; repeated call rows each come out under their id;
    a null time is never late.
    """
    ws = ws or Workspace(calls.sparkSession, "references")
    refs = call_references(calls)
    state = key_state(reference_deltas(refs).unionByName(existence_deltas(symbols)))
    bad = state.where((F.col("refs") > 0) & ((F.col("defs") <= 0) | (F.col("first_def") > F.col("first_ref"))))
    bad, total = ws.write_measured(bad.select(*KEYS, "refs", F.when(F.col("defs") > 0, F.col("first_def")).alias("first_def")), "state", F.sum("refs"))
    hit = skew_join(refs, bad, KEYS, "refs", total)
    late = F.col("first_def") > F.col("at")
    return hit.withColumn("state", F.when(F.col("first_def").isNull(), F.lit("missing")).when(late, F.lit("late"))).where("state is not null").drop("first_def")


def orphan_periods(found: DataFrame, table: str = "call_graph", unit: str = "month") -> DataFrame:
    """Counts per referring table, period of the reference and state."""
    return found.groupBy(F.lit(table).alias("table_name"), F.date_trunc(unit, F.col("at").cast("timestamp")).cast("date").alias("period"), "state").agg(
        F.count("*").alias("n_refs"), F.countDistinct("project_id", "name").alias("n_keys")
    )
