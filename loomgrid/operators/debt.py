"""Debt over time: snapshots of reviews, their trend, hours, badge and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.severity import HOURS, SEVERITIES, category, normal
from loomgrid.operators.ordering import numbered

RETENTION_DAYS = 90


def snapshots(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """(review_id, created_at, branch, quality_score, findings, categories): counts of each review as maps.

    Reviews stored twice count once; a review without issues has empty maps.
    """
    i = issues.select("review_id", normal("severity").alias("s"), category("issue_type").alias("c"))
    sev = i.groupBy("review_id").agg(*[F.count_if(F.col("s") == s).alias(s) for s in SEVERITIES])
    cat = i.groupBy("review_id", "c").agg(F.count("*").alias("n")).groupBy("review_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("categories"))
    r = reviews.dropDuplicates(["id"]).select(F.col("id").alias("review_id"), "created_at", "branch", (F.col("score") / 10.0).alias("quality_score"))
    f = F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.coalesce(F.col(s), F.lit(0)))])
    j = r.join(sev, "review_id", "left").join(cat, "review_id", "left")
    return j.select("review_id", "created_at", "branch", "quality_score", f.alias("findings"), F.coalesce("categories", F.create_map().cast("map<string,bigint>")).alias("categories"))


def halves(counts: DataFrame, order: list[str]) -> DataFrame:
    """Add recent: false for the first half of the series, true for the rest; of a single row, it is recent."""
    d = numbered(counts, order, "_row")
    n = d.agg(F.count("*").alias("_total"))
    recent = (F.col("_total") < 2) | (F.col("_row") > F.greatest(F.lit(1), F.floor(F.col("_total") / 2)))
    return d.join(F.broadcast(n)).withColumn("recent", recent).drop("_row", "_total")


def trend(change: Column) -> Column:
    """Fewer findings improve; a change by one either way is stable."""
    return F.when(change < -1, "improving").when(change > 1, "worsening").otherwise("stable")


def report(counts: DataFrame) -> DataFrame:
    """(reviews, total, change, trend, score_avg, score_change) of halved counts with columns n and quality_score."""
    r = F.col("recent")
    a = counts.agg(
        F.count("*").alias("reviews"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        (F.coalesce(F.sum(F.when(r, F.col("n"))), F.lit(0)) - F.coalesce(F.sum(F.when(~r, F.col("n"))), F.lit(0))).alias("change"),
        F.avg("quality_score").alias("_avg"), F.avg(F.when(r, F.col("quality_score"))).alias("_r"), F.avg(F.when(~r, F.col("quality_score"))).alias("_p"),
    )
    avg = F.coalesce("_avg", F.lit(0.0))
    return a.select("reviews", "total", "change", trend(F.col("change")).alias("trend"), F.round(avg, 6).alias("score_avg"), F.round(F.coalesce("_r", avg) - F.coalesce("_p", avg), 6).alias("score_change"))


def category_report(cats: DataFrame) -> DataFrame:
    """(name, n, change, trend) of halved (category, n) rows: n is the recent half."""
    r = F.col("recent")
    new, old = F.coalesce(F.sum(F.when(r, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~r, F.col("n"))), F.lit(0))
    return cats.groupBy(F.col("category").alias("name")).agg(new.alias("n"), (new - old).alias("change")).select("name", "n", "change", trend(F.col("change")).alias("trend"))


def debt_hours(counts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for s, w in HOURS.items():
        out = out + F.coalesce(counts[s], F.lit(0)) * w
    return F.round(out, 6)


def human_hours(h: Column) -> Column:
    """Minutes below an hour, hours below a day of eight, else days."""
    fixed = lambda x, n: F.replace(F.format_number(x, n), F.lit(","), F.lit(""))  # noqa: E731 - rounds the binary value half to even
    tagged = lambda x, n, unit: F.concat(F.lit("~"), fixed(x, n), F.lit(unit))
    return F.when(h < 1, tagged(h * 60, 0, "min")).when(h < 8, tagged(h, 1, "h")).otherwise(tagged(h / 8, 1, "d"))


def badge(score: Column, trend_: Column, hours: Column | None = None) -> Column:
    """Struct (schemaVersion, label, message, color) of a score; with hours the message names the debt."""
    arrow = F.when(trend_ == "improving", " ▼").when(trend_ == "worsening", " ▲").otherwise("")
    debt = F.concat(F.lit(" · debt "), human_hours(hours)) if hours is not None else F.lit("")
    color = F.when(score >= 8, "green").when(score >= 5, "yellow").otherwise("red")
    return F.struct(F.lit(1).alias("schemaVersion"), F.lit("code quality").alias("label"), F.concat(F.format_string("%.1f/10", score), debt, arrow).alias("message"), color.alias("color"))


def retained(snaps: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Snapshots of the last days."""
    return snaps.where(F.col("created_at") >= now - F.expr(f"interval {days} days"))


def since(snaps: DataFrame, start: str | None, branch: str | None) -> DataFrame:
    """Snapshots from a date (yyyy-MM-dd or RFC 3339) on, of one branch; a branch drops rows without one."""
    d = snaps
    if start:
        d = d.where(F.col("created_at") >= F.coalesce(F.try_to_timestamp(F.lit(start)), F.try_to_timestamp(F.lit(start), F.lit("yyyy-MM-dd"))))
    return d.where(F.col("branch") == branch) if branch else d


def sampled_points(snaps: DataFrame, most: int = 40) -> DataFrame:
    """At most ``most`` points of a series for a graph: every step-th by time, and the last."""
    d = numbered(snaps, ["created_at", "review_id"], "_row")
    n = d.agg(F.count("*").alias("_total"))
    step = F.greatest(F.lit(1), F.ceil(F.col("_total") / most))
    return d.join(F.broadcast(n)).where(((F.col("_row") - 1) % step == 0) | (F.col("_row") == F.col("_total"))).drop("_row", "_total")
