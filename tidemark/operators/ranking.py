"""Exact ranks inside large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, group: str, key: str, seed: int, shards: int | None = None) -> DataFrame:
    """Adds _rank (from 0, by a seeded hash of key, then key) and _size of each row's group.

    Ranges of the hash are shards; a row's rank is its place in its shard plus the sizes of the shards before. So a group of any size is spread
    over `shards` tasks (by default the number of shuffle partitions).
    """
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place: Column = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    df = df.withColumn("_h", place).withColumn("_shard", F.floor(F.col("_h") * shards / F.lit(1 << 40)))
    sizes = df.groupBy(group, "_shard").agg(F.count("*").alias("_n"))
    of = W.partitionBy(group)
    before = of.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_shard").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(of).alias("_size"))
    ranked = df.withColumn("_in", F.row_number().over(W.partitionBy(group, "_shard").orderBy("_h", key)))
    joined = ranked.join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_shard") == F.col("_s")))
    return joined.withColumn("_rank", F.col("_before") + F.col("_in") - 1).drop("_h", "_shard", "_g", "_s", "_before", "_in")
