"""Dates as Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def dashed(text: Column) -> Column:
    """YYYY-MM-DD of an eight-character date text; any other text as it is."""
    return F.when(F.length(text) == 8, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)


def parse_any(text: Column) -> Column:
    """A date in one of the three forms that list pages use, or null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-M-d", "yyyyMMdd", "yyyy-M-d H:m:s")]).cast("date")


def parse_compact(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def optional_date(text: Column) -> Column:
    """An ISO date; empty and invalid texts are null, that is no filter."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def previous_trading_day(d: Column) -> Column:
    return F.date_sub(d, F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1))


def trading_days(start: Column, end: Column) -> Column:
    """All weekdays from start to end, both included, as an array."""
    days = F.when(start <= end, F.sequence(start, end)).otherwise(F.expr("cast(array() as array<date>)"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def date_argument(text: str, today: dt.date | None = None) -> dt.date:
    """today, yesterday, YYYY-MM-DD or YYYYMMDD, for the command line."""
    today = today or dt.date.today()
    if text in ("today", "yesterday"):
        return today - dt.timedelta(days=text == "yesterday")
    return dt.date.fromisoformat(text)
