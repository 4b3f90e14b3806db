import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.bridge import Tables
from tidemark.sources.keywords import KeywordTable, needed, runs

SCHEMA = "id long, title string, extra string"


def plain(df, keyword):
    return sorted(r["id"] for r in df.where(F.col("title").ilike(f"%{keyword}%")).collect())


def found(table, keyword):
    return sorted(r["id"] for r in table.search(keyword).collect())


def test_runs_of_patterns():
    assert runs("%ab_c%") == ["ab", "c"] and runs(r"a\%b\_c\\") == ["a%b_c\\"] and runs("%_%") == []
    assert needed("%notice%") == {"not", "oti", "tic", "ice"} and needed("%分红_股%") == {"分红", "股"} and needed("") == set()


def test_same_rows_from_fewer_files(spark, tables, tmp_path):
    a = Tables(spark, tables).announcements
    table = KeywordTable(spark, f"file://{tmp_path}", a.schema, rows=50)
    table.add(a.where("id % 2 = 0"))
    table.add(a.where("id % 2 = 1"))
    for keyword in ("urgent", "1-URGENT notice 7", "1_urg%notice 9", "not specified", "e 4", "no such word", "%", ""):
        assert found(table, keyword) == plain(a, keyword), keyword
    parts = len(table.parts(""))
    assert parts >= a.count() // 50 and 0 < len(table.parts("1-URGENT notice 7")) < parts / 3 and table.parts("no such word") == []
    assert len(table.search("urgent").inputFiles()) < parts / 2


def test_random_titles_and_patterns(spark, tmp_path):
    rng = random.Random(5)
    chars = "abAB%_\\ 分红İßΣσς\n😀é"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, None if i % 50 == 0 else x, "e") for i, x in enumerate(texts)], SCHEMA)
    table = KeywordTable(spark, f"file://{tmp_path}", df.schema, rows=40)
    table.add(df)
    for _ in range(25):
        x = rng.choice(texts)
        at = rng.randrange(0, len(x) + 1)
        keyword = x[at : at + rng.randrange(0, 5)].replace("\\", "\\\\")
        assert found(table, keyword) == plain(df, keyword), repr(keyword)


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    table = KeywordTable(spark, f"file://{tmp_path}", empty.schema, rows=10)
    assert table.search("a").columns == ["id", "title", "extra"] and table.search("a").count() == 0
    table.add(empty)
    assert found(table, "a") == []
    same = spark.range(100).select("id", F.lit("Equal title").alias("title"), F.lit(None).cast("string").alias("extra"))
    table.add(same)
    assert found(table, "EQUAL") == list(range(100)) and len(table.parts("equal")) == 10  # equal titles fill several parts
    table.add(spark.createDataFrame([(7, "x" * 200_000 + "end", None), (7, "", None), (7, None, None)], SCHEMA))
    assert found(table, "xend") == [7] and found(table, "") == sorted([*range(100), 7, 7])
    left = spark.createDataFrame([(8, "xend", None)], SCHEMA)  # a batch that was never completed
    left.write.parquet(f"file://{tmp_path}/data/batch_=lost/part_=0")
    assert found(table, "xend") == [7]
    with pytest.raises(ValueError):
        KeywordTable(spark, f"file://{tmp_path}", same.withColumn("part_", F.lit(1)).schema)
