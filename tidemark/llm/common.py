"""Shared helpers of the training-data operators: shared folders, typed reads, broadcast bounds."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nothing larger is broadcast; callers measure first and have another way beyond it.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all runs on one machine (local tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not set_to and (found := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        set_to = found.get()
    if not set_to:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage: written once, reread by every consumer.

    They outlive lost executors, as the files are in shared storage. `drop` frees a table when nothing needs it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables of this scratch but the given ones, which alone a result still reads."""
        kept = {t._scratch for t in tables}
        for i in range(self.n):
            if f"{self.root}/{i}" not in kept:
                self._delete(f"{self.root}/{i}")

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(key, m: int):
    """crc32 of the key as text, modulo m."""
    return F.crc32(key.cast("string")) % m


#: The rows of one key that a join leaves in one task, unless a ten-thousandth of all rows are more.
HOT_ROWS = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An inner or left join of tables where a key may hold any share of left's rows; right has few rows a key.

    Keys of more than `HOT_ROWS` rows (and a ten-thousandth of all, so at most 10,000 keys, which are broadcast) are
    spread over shares by a hash of left's row; right's rows of these keys are copied to each share.
    """
    spark = left.sparkSession
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    counts = Scratch(spark, "spread").table(counts.where(F.col("_n") > HOT_ROWS))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if not total:
        return left.join(right, on, how)
    most = max(HOT_ROWS, total // 10_000)
    hot = F.broadcast(counts.where(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_shares")))
    one = left.join(hot, on, "left").withColumn("_share", F.pmod(F.xxhash64(*left.columns), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    two = right.join(hot, on, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return one.join(two, [*on, "_share"], how).drop("_share")


def free(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished plans: they go when the driver's garbage is collected, which takes more than one turn."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
