"""Committed tables: whole versions, touched partitions only, failed, repeated and competing writers."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage
from tidemark.sources.snapshots import Conflict, Snapshots


@pytest.fixture()
def table(spark):
    return Snapshots(spark, lineage.new_folder(spark, "table"), ["k"], buckets=8)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def frame(spark, values, schema="k string, v long, status string"):
    return spark.createDataFrame(values, schema)


def test_versions_follow_upserts(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    table.merge(frame(spark, [("a", 1, "old"), ("b", 2, "old"), (None, 3, "old")]))
    first = table.read()
    table.merge(frame(spark, [("a", 10, "new"), ("c", None, "new"), (None, None, "new"), ("c", 5, None)]), keep=("status",))
    assert rows(table.read(), "k", "v", "status") == [("a", 10, "old"), ("b", 2, "old"), ("c", 5, None), (None, 3, "old")]
    assert rows(first, "k", "v") == rows(table.read(1), "k", "v") == [("a", 1), ("b", 2), (None, 3)]
    table.replace(frame(spark, [("b", None, "x")]))
    assert ("b", None, "x") in rows(table.read(), "k", "v", "status") and table.versions() == [1, 2, 3]


def test_only_touched_partitions_are_rewritten(spark, table):
    table.merge(frame(spark, [(f"k{i}", i, "s") for i in range(200)]))
    before = table.version().parts
    table.merge(frame(spark, [("k7", -7, "s")]))
    after = table.version().parts
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 200 and table.read().where("v = -7").count() == 1


def test_a_failed_write_leaves_readers_on_a_whole_version(spark, table, monkeypatch):
    table.merge(frame(spark, [("a", 1, "s"), ("b", 2, "s")]))

    def broken(old, new):
        return old.unionByName(new).withColumn("v", F.when(F.col("k") == "c", F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="boom"):
        table.commit(frame(spark, [("c", 3, "s"), ("d", 4, "s")]), broken)
    monkeypatch.setattr(table, "_publish", lambda v: (_ for _ in ()).throw(RuntimeError("lost before the pointer moved")))
    with pytest.raises(RuntimeError):
        table.merge(frame(spark, [("a", 9, "s")]))
    monkeypatch.undo()
    assert rows(table.read(), "k", "v") == [("a", 1), ("b", 2)] and table.versions() == [1]
    assert len(table._names("data")) == 2  # what the unpublished one wrote is there, and of no version
    table.clean(older_than_seconds=0)
    assert len(table._names("data")) == 1 and rows(table.read(), "k", "v") == [("a", 1), ("b", 2)]


def test_a_repeated_batch_changes_nothing(spark, table):
    add = lambda old, new: old.unionByName(new)
    for number in (0, 0, 1, 0, 1):
        table.commit(frame(spark, [("a", number, "s")]), add, batch=("w", number))
    table.commit(frame(spark, []), add, batch=("other", 5))
    assert rows(table.read(), "k", "v") == [("a", 0), ("a", 1)] and table.version().batches == {"w": 1, "other": 5}


def test_of_two_writers_one_starts_again(spark, table, monkeypatch):
    table.merge(frame(spark, [("a", 1, "s"), ("b", 2, "s")]))
    rival, publish = Snapshots(spark, table.root, ["k"], 8), table._publish

    def late(version):
        if version.number == 2:
            rival.merge(frame(spark, [("a", 50, "s"), ("c", 3, "s")]))
        publish(version)

    monkeypatch.setattr(table, "_publish", late)
    assert table.merge(frame(spark, [("a", None, "t"), ("d", 4, "s")])) == 3
    assert rows(table.read(), "k", "v", "status") == [("a", 50, "t"), ("b", 2, "s"), ("c", 3, "s"), ("d", 4, "s")]
    monkeypatch.setattr(table, "_publish", lambda v: (_ for _ in ()).throw(Conflict("always")))
    with pytest.raises(Conflict):
        table.merge(frame(spark, [("a", 0, "s")]))


def test_added_columns_and_versions_that_go(spark, table):
    table.merge(frame(spark, [("a", 1, "s")]))
    assert table.add_columns({"pdf": "string", "v": "long"}) == 2 and table.add_columns({"pdf": "string"}) == 2
    assert rows(table.read(), "k", "pdf") == [("a", None)]
    table.merge(frame(spark, [("a", "u")], "k string, pdf string"))
    table.merge(frame(spark, []))
    assert rows(table.read(), "k", "v", "pdf") == [("a", 1, "u")] and table.versions() == [1, 2, 3]
    table.clean(keep=2, older_than_seconds=0)
    assert table.versions() == [2, 3] and rows(table.read(), "k", "v", "pdf") == [("a", 1, "u")] and rows(table.read(2), "pdf") == [(None,)]
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([("a", 1)], "k string, bucket_ long"))


def test_no_rows_at_all(spark, table):
    assert table.merge(frame(spark, [])) == 1 and table.read().count() == 0 and table.read().columns == ["k", "v", "status"]
    table.merge(frame(spark, [("a", 1, "s")]))
    table.commit(frame(spark, [("a", 0, "s")]), lambda old, new: old.where("false"))
    assert table.read().count() == 0
