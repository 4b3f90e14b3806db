"""Dashboard statistics: each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import taxonomy as T


def distribution(df: DataFrame, key: str, name: str = "n", skip_null: bool = False) -> DataFrame:
    df = df.where(F.col(key).isNotNull()) if skip_null else df
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)


def status_overview(announcements: DataFrame) -> DataFrame:
    """All statuses in order, with zero for those that no row has."""
    known = announcements.where(F.col("processing_status").isin(*T.STATUSES))  # so the counts are seven rows at most
    counts = known.groupBy(F.col("processing_status").alias("status")).agg(F.count("*").alias("n"))
    return T.statuses_df(announcements.sparkSession).join(F.broadcast(counts), "status", "left").select("place", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def direction_counts(composite: Column) -> list[Column]:
    """bullish, bearish and neutral as conditional counts of one pass; rows without a score count as none."""
    return [
        F.count_if(composite > 0.1).alias("bullish"),
        F.count_if(composite < -0.1).alias("bearish"),
        F.count_if(F.abs(composite) <= 0.1).alias("neutral"),
    ]


def direction_distribution(scores: DataFrame) -> DataFrame:
    """Three rows (direction, n), with zeros."""
    one = scores.agg(*direction_counts(F.col("composite_score")))
    return one.select(F.expr("stack(3, 'bullish', bullish, 'bearish', bearish, 'neutral', neutral) as (direction, n)"))


def report_totals(items: DataFrame, threshold: float = T.HIGH_IMPACT) -> DataFrame:
    c = F.col("composite_score")
    return items.agg(
        F.count("*").alias("total"), F.count_if(F.abs(c) >= threshold).alias("high"), F.count_if(c > 0.1).alias("bullish"), F.count_if(c < -0.1).alias("bearish")
    ).withColumn("neutral", F.col("total") - F.col("bullish") - F.col("bearish"))


def dashboard(announcements: DataFrame, classifications: DataFrame, scores: DataFrame, runs: DataFrame, reports: DataFrame) -> dict[str, DataFrame]:
    """The parts of the overview page, each a small DataFrame."""
    return {
        "status": status_overview(announcements),
        "total": announcements.agg(F.count("*").alias("total")),
        "high_impact": scores.agg(F.count_if(F.abs("composite_score") >= T.HIGH_IMPACT).alias("n")),
        "direction": direction_distribution(scores),
        "category": distribution(classifications, "major_category"),
        "industry": distribution(classifications, "industry_group", skip_null=True),
        "runs": runs.orderBy(F.desc("started_at"), "run_id").limit(10),
        "reports": reports.orderBy(F.desc("report_date"), "id").limit(10),
    }
