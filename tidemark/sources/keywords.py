"""Keyword search that reads only the file parts that can hold a match: an index from short strings to parts, then the exact comparison.

Rows are written in parts of near titles. For every part the index holds the distinct runs of one to three characters of its lower-cased titles. A keyword's
literal stretches (between `%` and `_`, which stay wildcards) name the runs that a matching title must have; parts that have all of them are read, and
`ILIKE` decides on their rows. So the index may let a part through in vain but never leaves out a match. A keyword of wildcards alone reads all parts.

A batch is complete when its name stands in `batches/`, written last: what a failed `add` has left is never read. Null titles match nothing, as with ILIKE; empty titles,
repeated rows and empty batches are rows like any other or none. A part holds `rows` rows; equal titles are parted by `key`, so a frequent title fills several parts.
The list of parts found goes to the driver, as a file listing does: one short name a part, never a row. Column names may be any but `batch_` and `part_`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, PART, GRAM = "batch_", "part_", "gram"
LONGEST = 3  # characters of an indexed run
ROWS = 100_000  # rows of a part


def runs(pattern: str) -> list[str]:
    """The literal stretches of a LIKE pattern; a backslash makes the next character literal."""
    found, run, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            found, run = [*found, run], ""
        else:
            at += c == "\\"
            run += pattern[at : at + 1]
        at += 1
    return [r for r in [*found, run] if r]


def needed(pattern: str) -> set[str]:
    """The indexed runs that a match of the (lower-cased) pattern holds: each stretch's longest ones."""
    return {r[i : i + LONGEST] for r in runs(pattern) for i in range(max(1, len(r) - LONGEST + 1))}


def grams(text: Column) -> Column:
    """All runs of one to LONGEST characters of a text, in time in proportion to its length."""
    found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, LONGEST + 1)]
    return F.array_distinct(F.concat(*found))


class KeywordTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, column: str = "title", key: str = "id", rows: int = ROWS):
        if {BATCH, PART} & set(schema.names):
            raise ValueError(f"{BATCH} and {PART} are no column names of the table")
        self.spark, self.root, self.column, self.key, self.rows = spark, root.rstrip("/"), column, key, rows
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

    def add(self, df: DataFrame) -> None:
        """Adds the rows as one batch: in parts, then their index, then the batch's name."""
        batch, text = uuid.uuid4().hex, F.lower(F.col(f"`{self.column}`"))
        parts = max(1, -(-df.count() // self.rows))
        dealt = df.select(*[F.col(f"`{n}`") for n in self.schema.names]).repartitionByRange(parts, text, F.col(f"`{self.key}`"))
        data = f"{self.root}/data/{BATCH}={batch}"
        dealt.withColumn(PART, F.spark_partition_id()).write.partitionBy(PART).parquet(data)
        if self._fs().globStatus(self._path(f"{data}/{PART}=*")):
            written = self.spark.read.schema(T.StructType([*self.schema, T.StructField(PART, T.IntegerType())])).parquet(data)
            pairs = written.select(PART, F.explode(grams(text)).alias(GRAM)).distinct()  # at most the parts a run
            pairs.repartitionByRange(GRAM, PART).sortWithinPartitions(GRAM, PART).write.parquet(f"{self.root}/index/{BATCH}={batch}")
            self._fs().create(self._path(f"{self.root}/batches/{batch}"), False).close()

    def parts(self, keyword: str) -> list[str]:
        """Folders of the parts that can hold a match."""
        wanted = sorted(needed(self.spark.sql("SELECT lower(?) AS p", args=[f"%{keyword}%"]).first()["p"]))
        batches = self._names("batches")
        if not batches:
            return []
        if not wanted:
            return [f"{self.root}/data/{BATCH}={b}/{n}" for b in batches for n in self._names(f"data/{BATCH}={b}") if n.startswith(f"{PART}=")]
        schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField(GRAM, T.StringType()), T.StructField(BATCH, T.StringType())])
        index = self.spark.read.schema(schema).option("basePath", f"{self.root}/index").parquet(*[f"{self.root}/index/{BATCH}={b}" for b in batches])
        found = index.where(F.col(GRAM).isin(wanted)).groupBy(BATCH, PART).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
        return sorted(f"{self.root}/data/{BATCH}={r[BATCH]}/{PART}={r[PART]}" for r in found.collect())

    def search(self, keyword: str) -> DataFrame:
        """The rows whose title holds the keyword, `%` and `_` in it being wildcards."""
        parts = self.parts(keyword)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema, T.StructField(BATCH, T.StringType()), T.StructField(PART, T.IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*parts)
        return rows.where(F.col(f"`{self.column}`").ilike(f"%{keyword}%")).select(*[F.col(f"`{n}`") for n in self.schema.names])

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs().listStatus(at)) if self._fs().exists(at) else []
