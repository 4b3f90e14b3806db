"""Facts laid out for their joins: bucketed by the key they are joined on, in partitions of years.

Tables of one `Layout` have the same number of buckets, so joins and groupings by the key need no exchange, and a range of days reads only its years. A table
is written once to a folder of its own and named in the session's catalog; another session names it again with `attach`.

A bucket is read by one task. So a table of which one bucket would hold more than `SHARE` times its fair part (a hot key, nulls among them) is
written without buckets, and Spark exchanges and splits its rows as usual: results are the same. Empty tables, repeated rows and null keys or days are kept as they are
(rows without a day form a partition of their own). Column names may be any but `year_`.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = "year_"
ROWS = 2_000_000  # rows of the largest table that make one bucket
MOST = 100_000  # Spark's own limit of buckets
SHARE = 4  # a bucket of more than so many fair parts is hot
SMALL = 100_000  # rows of a dimension that is sent to all executors


def buckets_for(rows: int, least: int = 8, each: int = ROWS) -> int:
    """Buckets of the layout of tables of at most `rows` rows."""
    return min(MOST, max(least, -(-rows // each)))


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """The dimension, to be broadcast if it has at most `rows` rows; beyond that Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Layout:
    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def hot(self, df: DataFrame, key: str) -> bool:
        """Whether one bucket would hold more than SHARE fair parts and more than a bucket's rows; one pass over the key column."""
        sizes = df.groupBy(F.pmod(F.hash(F.col(f"`{key}`")), F.lit(self.buckets)).alias("b")).agg(F.count("*").alias("n"))
        most, total = sizes.agg(F.max("n"), F.sum("n")).first()
        return bool(total) and most > max(ROWS, SHARE * total / self.buckets)

    def write(self, name: str, df: DataFrame, key: str, day: str | None = None) -> DataFrame:
        """The table as written: in buckets of `key`, one file a bucket and year."""
        if YEAR in df.columns:
            raise ValueError(f"{YEAR} is no column name of a laid-out table")
        rows = df if day is None else df.withColumn(YEAR, F.year(F.col(f"`{day}`")))
        flat, table = self.hot(df, key), self._table(name)
        writer = (rows if flat else rows.repartition(self.buckets, F.col(f"`{key}`"))).write.format("parquet").option("path", self._path(name, flat))
        if day is not None:
            writer = writer.partitionBy(YEAR)
        if not flat:
            writer = writer.bucketBy(self.buckets, key).sortBy(key)
        writer.saveAsTable(table)
        return self.spark.table(table)

    def attach(self, name: str, key: str, flat: bool = False) -> DataFrame:
        """A table that an earlier session has written, under a new name of this session's catalog."""
        path, table = self._path(name, flat), self._table(name)
        schema = self.spark.read.parquet(path).schema
        parted = YEAR in schema.names
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        clustered = "" if flat else f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {f'PARTITIONED BY (`{YEAR}`)' if parted else ''} {clustered} LOCATION '{path}'")
        if parted:
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return self.spark.table(table)

    def _path(self, name: str, flat: bool) -> str:
        return f"{self.root}/{name}-{'flat' if flat else self.buckets}"

    def _table(self, name: str) -> str:
        return f"laid_{name}_{uuid.uuid4().hex}"


def between(df: DataFrame, day: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Rows of the days from start to end, both included; of a laid-out table only the partitions of their years are read."""
    for limit, holds in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if limit is not None:
            df = df.where(holds(F.col(YEAR), F.lit(limit.year)) & holds(F.col(day), F.lit(limit)))
    return df
