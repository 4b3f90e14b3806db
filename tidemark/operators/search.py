"""Filters, paging and lookups over announcements. Joins are added only for the filters that need them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import direction_label
from .lineage import stored


@dataclass(frozen=True)
class Filters:
    """All conditions hold together; None and "" are no condition."""

    start_date: dt.date | None = None
    end_date: dt.date | None = None
    industry_group: str | None = None
    major_category: str | None = None
    direction: str | None = None
    status: str | None = None
    keyword: str | None = None


def direction_filter(composite: Column, direction: str) -> Column:
    """bullish above 0.1, bearish below -0.1; any other word means neutral."""
    return {"bullish": composite > 0.1, "bearish": composite < -0.1}.get(direction, F.abs(composite) <= 0.1)


def filtered(announcements: DataFrame, classifications: DataFrame, scores: DataFrame, f: Filters) -> DataFrame:
    df = announcements
    if f.start_date:
        df = df.where(F.col("published_date") >= F.lit(f.start_date))
    if f.end_date:
        df = df.where(F.col("published_date") <= F.lit(f.end_date))
    if f.status:
        df = df.where(F.col("processing_status") == f.status)
    if f.keyword:
        df = df.where(F.col("title").ilike(f"%{f.keyword}%"))
    if f.industry_group or f.major_category:
        c = classifications.select(F.col("announcement_id").alias("_c"), "industry_group", "major_category")
        if f.industry_group:
            c = c.where(F.col("industry_group") == f.industry_group)
        if f.major_category:
            c = c.where(F.col("major_category") == f.major_category)
        df = df.join(c.select("_c"), F.col("id") == F.col("_c"), "left_semi")
    if f.direction:
        s = scores.where(direction_filter(F.col("composite_score"), f.direction)).select(F.col("announcement_id").alias("_s"))
        df = df.join(s, F.col("id") == F.col("_s"), "left_semi")
    return df


def page_bounds(page: int, size: int) -> tuple[int, int]:
    return max(1, page), min(100, max(1, size))


def page(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Newest first; a page is a top-k of offset + size rows, so nothing is sorted as a whole."""
    number, size = page_bounds(number, size)
    return df.orderBy(F.desc("published_date"), F.desc("id")).offset((number - 1) * size).limit(size)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("published_date"), F.desc_nulls_last("id")]


def page_after(df: DataFrame, last_date: dt.date | None, last_id: int, size: int = 20, inclusive: bool = False) -> DataFrame:
    """The page that follows the row (last_date, last_id), or begins with it: a top-k of `size` rows at any depth. Rows without a date come last."""
    date, own = F.col("published_date"), F.col("id")
    below = (own <= last_id) if inclusive else (own < last_id)
    if last_date is None:
        rest = date.isNull() & below
    else:
        day = F.lit(last_date)
        rest = (date < day) | ((date == day) & below) | date.isNull()
    return df.where(rest).orderBy(*newest_first()).limit(page_bounds(1, size)[1])


def page_starts(df: DataFrame, size: int = 20) -> DataFrame:
    """(page, published_date, id): the first row of every page, numbered by ranges without gathering rows. Store it, and any page is one `page_after` away."""
    size = page_bounds(1, size)[1]
    dealt = df.select("published_date", "id").repartitionByRange(*newest_first()).withColumn("_part", F.spark_partition_id())
    rows = stored(dealt.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*newest_first()))))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a range
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    at = F.col("_before") + F.col("_n") - 1
    return rows.join(F.broadcast(before), "_part").where(at % size == 0).select((F.floor(at / size) + 1).cast("long").alias("page"), "published_date", "id")


def deep_page(df: DataFrame, starts: DataFrame, number: int, size: int = 20) -> DataFrame:
    """A page by its number from stored page starts; one beyond the last is empty."""
    first = starts.where(F.col("page") == max(1, number)).first()
    return page_after(df, first["published_date"], first["id"], size, inclusive=True) if first else df.limit(0)


def search(announcements: DataFrame, classifications: DataFrame, scores: DataFrame, f: Filters, number: int = 1, size: int = 20) -> DataFrame:
    """A page with its direction labels: the page is cut first, then its few rows are joined with their scores."""
    rows = page(filtered(announcements, classifications, scores, f), number, size)
    s = scores.select(F.col("announcement_id").alias("_s"), "composite_score")
    joined = rows.join(s, F.col("id") == F.col("_s"), "left").drop("_s")
    return joined.withColumn("direction", F.when(F.col("composite_score").isNotNull(), direction_label(F.col("composite_score"))))


def count_pages(df: DataFrame, size: int = 20) -> DataFrame:
    """total and total_pages (1 at least)."""
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / F.lit(size))))


def by_status(announcements: DataFrame, status: str, limit: int = 100) -> DataFrame:
    return announcements.where(F.col("processing_status") == status).orderBy("id").limit(limit)


def high_impact(scores: DataFrame, threshold: float = 0.5, limit: int = 50) -> DataFrame:
    strength = F.abs("composite_score")
    return scores.where(strength >= threshold).orderBy(F.desc(strength), "announcement_id").limit(limit)


def details(announcements: DataFrame, companies: DataFrame, classifications: DataFrame, scores: DataFrame) -> DataFrame:
    """Announcements with what is known of them; a missing side is null."""
    co = companies.select(F.col("id").alias("company_id"), "stock_code", "stock_name", "industry")
    cl = classifications.select(F.col("announcement_id").alias("id"), "major_category", "sub_category", "confidence", "industry_group")
    sc = scores.select(F.col("announcement_id").alias("id"), "direction", "magnitude", "surprise", "credibility", "composite_score")
    return announcements.join(cl, "id", "left").join(sc, "id", "left").join(co, "company_id", "left")  # one exchange by id for the first two
