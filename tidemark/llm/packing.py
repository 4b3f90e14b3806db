"""Packing by optimal length buckets.

Token counts (words, [^\\x20\\x09-\\x0D]+) form one global histogram of all distinct counts (at most the square root of twice all
tokens), each with its rows and tokens. Dynamic programming over them, by divide and conquer as best splits grow with the count, chooses the
`buckets` boundaries that minimise the total padding when each row is padded to its bucket's boundary. Inside each bucket, rows form batches whose
padded size is at most `budget` tokens; a row longer than the budget is a batch of its own, never cut.

Token counts are made once, into a table in the shared folder, which all passes read. Batches are numbered by a distributed ranking in the order of
the md5 of doc_id, then of the count: ranges of that hash are shards, rows are numbered in each, and the shards' sizes give each shard's offset, so every batch of a bucket but its last
is full and no bucket meets in one task. The rows of a doc_id (or null) that has more than `HOT` of them, and a thousandth of all, are spread over `SPLIT` shards of their own.

Null and empty texts have 0 tokens and count as one of padding. A null doc_id ranks as the empty text; repeated rows all stay, each
in its own slot. An empty table gives an empty result. Other columns pass through; the result's names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKETS, BUDGET = 16, 8192
HOT, SPLIT = 100_000, 256
ADDED = ("n_tokens", "bucket", "padded_to", "batch", "slot")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def histogram(counts: DataFrame) -> list[tuple[int, int, int]]:
    """(count, rows, tokens) of each distinct token count, ascending."""
    rows = counts.groupBy("n_tokens").agg(F.count("*").alias("n"))
    return sorted((r["n_tokens"], r["n"], r["n_tokens"] * r["n"]) for r in rows.collect())


def boundaries(bins: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """The boundaries of least padding: best[k][j] = min over i of best[k-1][i] + padding of bins i..j in one bucket."""
    if not bins:
        return []
    top, n, t = (np.asarray(x, float) for x in zip(*bins, strict=True))
    top = np.maximum(top, 1)
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(t)])
    m = len(top)
    best, choice = top * rows[1:] - tokens[1:], []
    for _ in range(1, min(buckets, m)):
        new, came = best.copy(), np.full(m, -1)
        todo = [(1, m - 1, 0, m - 2)]  # bins, and the range of their best splits, which grow with the bin
        while todo:
            lo, hi, a, z = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            z_j = min(z, j - 1)
            cost = best[a : z_j + 1] + top[j] * (rows[j + 1] - rows[a + 1 : z_j + 2]) - (tokens[j + 1] - tokens[a + 1 : z_j + 2])
            i = a + int(cost.argmin())
            if cost[i - a] < new[j]:
                new[j], came[j] = cost[i - a], i
            todo += [(lo, j - 1, a, i), (j + 1, hi, i, z)]
        choice.append(came)
        best = new
    out, j, k = [], m - 1, len(choice) - 1
    while True:
        while k >= 0 and choice[k][j] < 0:
            k -= 1
        out.append(int(top[j]))
        if k < 0:
            return out[::-1]
        j, k = int(choice[k][j]), k - 1


def counted(docs: DataFrame) -> DataFrame:
    return docs.drop(*ADDED).withColumn("n_tokens", token_count(F.col("text")))


def place(counts: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Adds bucket, padded_to, batch and slot to rows with a doc_id and n_tokens, which are read three times."""
    spark, columns = counts.sparkSession, counts.columns
    found = histogram(counts)
    edges = boundaries(found, buckets)
    if not edges:
        return counts.withColumns({"bucket": F.lit(0), "padded_to": F.lit(0).cast("long"), "batch": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")})
    bounds = F.array(*[F.lit(e).cast("long") for e in edges])
    ranges = common.bucket_count(spark)
    hash_of = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    share = F.floor(F.conv(F.substring("_m", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("int")
    rows = counts.withColumns({"bucket": F.size(F.filter(bounds, lambda e: e < F.col("n_tokens"))), "_m": hash_of})
    rows = rows.withColumns({"_range": share, "_split": F.lit(0)})
    least = max(hot, sum(n for _, n, _ in found) // 1000)  # so at most 1000 ids are hot, whatever the input
    many = [r["_m"] for r in rows.groupBy("_m").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()]
    if many:
        row = F.xxhash64("_metadata.file_path", "_metadata.row_index") if hasattr(counts, "_scratch") else F.monotonically_increasing_id()
        rows = counts.withColumn("_row", row).withColumns({"bucket": F.size(F.filter(bounds, lambda e: e < F.col("n_tokens"))), "_m": hash_of})
        rows = rows.withColumns({"_range": share, "_split": F.when(F.col("_m").isin(many), 1 + F.pmod("_row", F.lit(SPLIT)).cast("int")).otherwise(0)}).drop("_row")
    # a hot id's rows follow its range's others, as a block of their own
    shard = ["bucket", "_range", "_split"] if not many else ["bucket", "_range", "_own", "_split"]
    if many:
        rows = rows.withColumn("_own", F.when(F.col("_split") > 0, F.col("_m")).otherwise(F.lit("")))
    sizes = rows.groupBy(*shard).agg(F.count("*").alias("_n"))
    before = W.partitionBy("bucket").orderBy(*shard[1:]).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*shard).orderBy("_m", "n_tokens", "doc_id"))).join(offsets, shard)
    at = F.col("_before") + F.col("_rank") - 1
    padded = F.get(bounds, F.col("bucket"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / padded))
    return ranked.withColumns({"padded_to": padded, "batch": F.floor(at / room), "slot": at % room}).select(*[F.col(f"`{c}`") for c in columns], "bucket", "padded_to", "batch", "slot")


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Adds n_tokens, bucket, padded_to, batch and slot."""
    return place(common.Scratch(docs.sparkSession, "packing").table(counted(docs), compression="zstd"), buckets, budget, hot)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = common.Scratch(spark, "packing").table(counted(docs).drop("text"))
    return place(counts).select("doc_id", *ADDED)


def packing_sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same programme, one level a bucket: cost and split are kept as one number, so that the least cost takes its least split."""
    split = 1 << 24
    levels = "c0 AS (SELECT j, (top * rows_to - tokens_to)::HUGEINT AS cost, [top] AS edges FROM bins)"
    for k in range(1, buckets):
        levels += f""",
s{k} AS (SELECT b.j, min((a.cost + (b.top * (b.rows_to - x.rows_to) - (b.tokens_to - x.tokens_to))::HUGEINT) * {split} + x.j) AS v
  FROM bins b JOIN bins x ON x.j < b.j JOIN c{k - 1} a ON a.j = x.j GROUP BY b.j),
c{k} AS (SELECT o.j, CASE WHEN s.v // {split} < o.cost THEN s.v // {split} ELSE o.cost END AS cost,
  CASE WHEN s.v // {split} < o.cost THEN list_append(p.edges, b.top) ELSE o.edges END AS edges
  FROM c{k - 1} o JOIN bins b ON b.j = o.j LEFT JOIN s{k} s ON s.j = o.j LEFT JOIN c{k - 1} p ON p.j = s.v % {split})"""
    return rf"""
WITH counts AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
grouped AS (SELECT n_tokens, count(*) AS n FROM counts GROUP BY n_tokens),
bins AS MATERIALIZED (SELECT row_number() OVER w - 1 AS j, greatest(n_tokens, 1) AS top, sum(n) OVER w AS rows_to, sum(n * n_tokens) OVER w AS tokens_to
  FROM grouped WINDOW w AS (ORDER BY n_tokens)),
{levels},
chosen AS (SELECT edges FROM c{buckets - 1} ORDER BY j DESC LIMIT 1),
placed AS (SELECT doc_id, n_tokens, len(list_filter(edges, lambda e: e < n_tokens))::INT AS bucket, edges FROM counts, chosen),
ranked AS (SELECT *, edges[bucket + 1]::BIGINT AS padded_to, row_number() OVER (PARTITION BY bucket ORDER BY md5(coalesce(doc_id::VARCHAR, '')), n_tokens, doc_id) - 1 AS spot FROM placed)
SELECT doc_id, n_tokens, bucket, padded_to, (spot // greatest(1, {budget} // padded_to))::BIGINT AS batch, (spot % greatest(1, {budget} // padded_to))::BIGINT AS slot FROM ranked"""


OP4_SQL = packing_sql()
