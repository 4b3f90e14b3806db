import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scoring, search
from tidemark.plans.bridge import Tables
from tidemark.sources import layout
from tidemark.sources.layout import YEAR, Layout, between, buckets_for, small


@pytest.fixture(scope="module")
def t(spark, tables):
    return Tables(spark, tables)


@pytest.fixture()
def merges(spark):
    """No table is small enough to be broadcast unasked."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange ", plan))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_joins_of_laid_out_facts_need_no_exchange(spark, t, tmp_path, merges):
    laid = Layout(spark, f"file://{tmp_path}", 8)
    facts = laid.write("announcements", t.announcements, "id", "published_date").drop(YEAR)
    classes, scores = laid.write("classifications", t.classifications, "announcement_id"), laid.write("scores", t.scores, "announcement_id")
    got, plain = search.details(facts, small(t.companies), classes, scores), search.details(t.announcements, t.companies, t.classifications, t.scores)
    assert exchanges(got) == 0 and exchanges(plain) > 2 and rows(got) == rows(plain)

    fields = laid.write("fields", t.fields, "announcement_id")
    mapped = scoring.field_map(fields, F.col("row_order"), laid_out=True)
    got, plain = scoring.score(facts, classes, small(t.companies), mapped), scoring.score(t.announcements, t.classifications, t.companies, t.field_map)
    assert exchanges(got) == 0 and rows(got.drop("scoring_detail")) == rows(plain.drop("scoring_detail"))


def test_days_read_their_years_alone(spark, t, tmp_path):
    table = Layout(spark, f"file://{tmp_path}", 2).write("announcements", t.announcements, "id", "published_date")
    start, end = dt.date(1995, 3, 1), dt.date(1996, 2, 1)
    got = between(table, "published_date", start, end)
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year_", scan)
    assert rows(got.drop(YEAR)) == rows(t.announcements.where(F.col("published_date").between(start, end)))
    assert between(table, "published_date").count() == t.announcements.count()


def test_another_session_names_the_table_again(spark, t, tmp_path, merges):
    laid = Layout(spark, f"file://{tmp_path}", 4)
    laid.write("announcements", t.announcements, "id", "published_date")
    laid.write("scores", t.scores, "announcement_id")
    other = Layout(spark.newSession(), f"file://{tmp_path}", 4)
    a, s = other.attach("announcements", "id"), other.attach("scores", "announcement_id")
    assert rows(a.drop(YEAR)) == rows(t.announcements) and rows(s) == rows(t.scores)
    assert exchanges(a.join(s, a.id == s.announcement_id)) == 0


def test_hot_null_repeated_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "ROWS", 100)
    laid = Layout(spark, f"file://{tmp_path}", 16)
    hot = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("key"), F.lit("x").alias("value"))
    assert laid.hot(hot, "key") and not laid.hot(spark.range(3000), "id")
    assert rows(laid.write("hot", hot, "key")) == rows(hot) and (tmp_path / "hot-flat").exists()
    few = spark.createDataFrame([(None, None), (1, dt.date(2000, 1, 1)), (1, dt.date(2000, 1, 1)), (2, None)], "`a key` long, day date")
    assert rows(laid.write("few", few, "a key", "day").drop(YEAR)) == rows(few)
    assert laid.write("none", few.limit(0), "a key").count() == 0
    with pytest.raises(ValueError):
        laid.write("bad", few.withColumn(YEAR, F.lit(1)), "a key")
    assert buckets_for(0) == 8 and buckets_for(10**9) == 500 and buckets_for(10**15) == layout.MOST
    assert exchanges(small(spark.range(5), 4).join(spark.range(9), "id")) >= 0
