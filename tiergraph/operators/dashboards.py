"""Roll-ups for teams: pain points, trends, gaps, tier mixes, rankings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pain_points(rows: DataFrame, *, label: str, segment: str, sentiment: str, source_id: str, min_volume: int = 1, evidence: int = 5) -> DataFrame:
    """(label, segment, volume, avg_sentiment, evidence): by volume, then by how strong the mean is."""
    #: The least ids, kept in a bounded aggregate, not all of a group.
    grouped = rows.groupBy(label, segment).agg(F.count("*").alias("volume"), F.round(F.avg(sentiment), 4).alias("avg_sentiment"))
    firsts = first_ids(rows, [label, segment], source_id, evidence)
    return grouped.where(F.col("volume") >= min_volume).join(firsts, [label, segment], "left").orderBy(F.desc("volume"), F.desc(F.abs("avg_sentiment")), label, segment)


def first_ids(rows: DataFrame, by: list[str], id_col: str, n: int) -> DataFrame:
    """(by, evidence): the n least distinct ids of each group. The rank limit also works before the shuffle, so a task sends n ids a group."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(id_col))
    few = rows.select(*by, id_col).withColumn("__place", place).where(F.col("__place") <= n)
    return few.groupBy(*by).agg(F.array_sort(F.collect_set(id_col)).alias("evidence"))


def daily(rows: DataFrame, by: list[str], time: str, value: str, *, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """(by, day, volume, mean) of the rows in [start, end]."""
    kept = rows if start is None else rows.where(F.col(time) >= F.lit(start))
    kept = kept if end is None else kept.where(F.col(time) <= F.lit(end))
    return kept.groupBy(*by, F.date_format(time, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("volume"), F.round(F.avg(value), 8).alias("mean"))


def mix(rows: DataFrame, by: list[str], part: str) -> DataFrame:
    """(by, part, n, fraction) within each group, from counts."""
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("__all"))
    return counts.join(total, by).select(*by, part, "n", F.round(F.col("n") / F.col("__all"), 4).alias("fraction"))


def top_clusters(rows: DataFrame, cluster: str, *, n: int = 5) -> DataFrame:
    return rows.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("volume")).orderBy(F.desc("volume"), cluster).limit(n)


def trending(rows: DataFrame, *, topic: str, time: str, value: str, as_of: datetime, window_days: int = 30, baseline_days: int = 180, min_ratio: float = 2.0) -> DataFrame:
    """Topics whose daily rate in the window is ``min_ratio`` times that of the days before it, a rate of 0.05 at least.

    What comes after ``as_of`` counts to the window.
    """
    end = F.lit(as_of)
    start, base = end - F.expr(f"interval {window_days} days"), end - F.expr(f"interval {baseline_days} days")
    now, before = F.col(time) >= start, (F.col(time) >= base) & (F.col(time) < start)
    counts = rows.where(F.col(time) >= base).groupBy(topic).agg(F.sum(now.cast("long")).alias("window_volume"), F.sum(before.cast("long")).alias("baseline_volume"), F.round(F.avg(F.when(now, F.col(value))), 4).alias("avg_sentiment"))
    ratio = (F.col("window_volume") / window_days) / F.greatest(F.col("baseline_volume") / (baseline_days - window_days), F.lit(0.05))
    return counts.where("window_volume > 0").withColumn("trend_ratio", F.round(ratio, 4)).where(F.col("trend_ratio") >= min_ratio).orderBy(F.desc("trend_ratio"), topic)


def content_gaps(rows: DataFrame, *, topic: str, value: str, min_volume: int = 3, below: float = 0.0) -> DataFrame:
    """Topics that are talked about and badly so; severity is volume times (0.1 - mean)."""
    g = rows.groupBy(topic).agg(F.count("*").alias("volume"), F.avg(value).alias("__mean")).where((F.col("volume") >= min_volume) & (F.col("__mean") < below))
    return g.select(topic, "volume", F.round("__mean", 4).alias("avg_sentiment"), F.round(F.col("volume") * F.greatest(F.lit(0.0), 0.1 - F.col("__mean")), 4).alias("gap_severity")).orderBy(F.desc("gap_severity"), topic)


def best_per_entity(rows: DataFrame, entity: str, support: str, columns: list[str], *, least: int) -> DataFrame:
    """The row with most support of each entity, if it has enough; ties by the columns."""
    best = rows.groupBy(entity).agg(F.max(F.struct(support, *columns)).alias("__m"))
    return best.where(F.col(f"__m.{support}") >= least).select(entity, "__m.*")


def month_spend(rows: DataFrame, by: str, time: str, amount: str, now: datetime) -> DataFrame:
    return rows.where((F.col(time) >= F.date_trunc("month", F.lit(now))) & (F.col(time) <= F.lit(now))).groupBy(by).agg(F.round(F.sum(amount), 4).alias("spent"))


def due_jobs(jobs: DataFrame, spend: DataFrame, by: str, *, due: str, budget: str, status: str = "status", now: datetime, limit: int = 50) -> DataFrame:
    """Active jobs whose time has come and whose domain has budget left, oldest first."""
    ready = jobs.where((F.col(status) == "active") & (F.col(due) <= F.lit(now))).join(spend, by, "left")
    return ready.where(F.coalesce("spent", F.lit(0.0)) < F.col(budget)).orderBy(due, by).limit(limit)
