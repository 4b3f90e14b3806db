"""Upserts as joins: plain files have no MERGE, so each gives the table's new content, to be written as a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _last(new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row a key: the last by `order`; of ties, and without an order, the greatest row, column by column (nulls are least)."""
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return new.distinct()
    row = F.struct(*rest)
    one = new.groupBy(*keys).agg((F.max(row) if order is None else F.max_by(row, F.struct(F.col(order), row))).alias("_r"))
    return one.select(*keys, "_r.*")


def merge_non_null(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Old rows take the new row's non-null values, except in the columns `keep`; rows of new keys are added. Keys match null-safely."""
    new = _last(new, keys, order)
    joined = old.select(F.struct(*[F.col(c) for c in old.columns]).alias("o"), *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)]).join(
        new.select(F.struct(*[F.col(c) for c in new.columns]).alias("n"), *[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)]),
        _all([F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}")) for i in range(len(keys))]),
        "full",
    )
    columns = []
    for c in old.columns:
        if c not in new.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c in keep or c in keys:
            columns.append(F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            columns.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
    return joined.select(*columns)


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new keys that the table doesn't have yet."""
    return new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")


def replace(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows win as a whole, nulls included; other old rows stay."""
    new = _last(new, keys, order)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_all(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of every key that `new` has are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def set_status(announcements: DataFrame, changes: DataFrame) -> DataFrame:
    """Status and error of the rows in changes (id, status, error); a null error clears the old one."""
    c = changes.select(F.col("id"), F.col("status").alias("_s"), F.col("error").alias("_e"), F.lit(True).alias("_hit"))
    df = announcements.join(c, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return df.withColumns({"processing_status": F.when(hit, F.col("_s")).otherwise(F.col("processing_status")), "error_message": F.when(hit, F.col("_e")).otherwise(F.col("error_message"))}).drop("_s", "_e", "_hit")


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the missing ones of {name: type} as nulls; does nothing the second time."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
