import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import stages, taxonomy
from tidemark.sources import readers
from tidemark.streaming import incremental


def test_jsonl(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"announcement_id": "1", "text": "t", "sub_category": "Abc"}\n\n{bad\n{"text": "u", "sub_category": "Bcd", "major_category": "Z"}\n')
    got = {(r["text"], r["major_category"]) for r in readers.labelled_jsonl(spark, str(p)).collect()}
    assert got == {("t", "A"), ("u", "Z")}
    readers.write_jsonl(readers.labelled_jsonl(spark, str(p)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def _page(n, hits, items, total=None):
    data = {"page_index": n, "page_size": 50, "total_hits": hits, "list": [{"art_code": i, "title": "t", "notice_date": "", "notice_content": ""} for i in items]}
    return json.dumps({"data": data | ({"total_page": total} if total is not None else {})})


def test_list_pages(spark):
    rows = [("1", 1, _page(1, 100, ["a", "b"])), ("1", 2, _page(2, 100, ["c", "d"])), ("1", 3, _page(3, 100, ["e"])), ("2", 1, _page(1, 2, ["f"])), ("2", 2, _page(2, 2, ["g"])), ("3", 1, _page(1, 500, [])), ("3", 2, _page(2, 500, ["h"])), ("4", 1, "oops")]
    got = readers.list_items(spark.createDataFrame(rows, "company_code string, page_index int, payload string"))
    assert sorted(r["art_code"] for r in got.collect()) == ["a", "b", "c", "d", "f"]


def test_retry():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert readers.with_retry(flaky, wait=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(ValueError):
        readers.with_retry(lambda: (_ for _ in ()).throw(ValueError()), wait=lambda s: None)
    assert readers.with_retry(lambda: 1, attempts=0) == {}


def test_vendor_source(spark):
    spark.dataSource.register(readers.vendor_source(lambda endpoint, parameters: [(endpoint, parameters["v"]), ("x", "y")], per_minute=6000))
    df = spark.read.format("vendor").option("endpoint", "daily").option("parameters", '{"v": "1"}').load()
    assert {tuple(r) for r in df.collect()} == {("daily", "1"), ("x", "y")} and df.rdd.getNumPartitions() == 1


def test_call_out(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i int, text string").repartition(3)
    got = readers.call_out(df, "text", "answer", lambda texts: [t.upper() for t in texts], batch=7)
    assert all(r["answer"] == f"T{r['i']}" for r in got.collect())


def test_seed_companies(spark):
    df = spark.createDataFrame([("1.SH", "a", "化学制药"), ("2.SZ", "b", None)], "ts_code string, name string, industry string")
    assert {(r["exchange"], r["is_tracked"]) for r in readers.seed_companies(df, ["制药"]).collect()} == {("SSE", True), ("SZSE", False)}


def test_incremental(spark, tmp_path):
    seen = []
    src, chk = str(tmp_path / "in"), str(tmp_path / "chk")
    spark.range(3).write.parquet(src)
    incremental.run_available(spark, src, "id long", chk, lambda b, i: seen.append(b.count())).awaitTermination()
    spark.range(2).write.mode("append").parquet(src)
    incremental.run_available(spark, src, "id long", chk, lambda b, i: seen.append(b.count())).awaitTermination()
    assert seen == [3, 2]


def test_list_pages_and_bodies_are_fetched(spark):
    def listing(endpoint, parameters):
        if endpoint == "content":
            return {"data": {"notice_content": "body " + parameters["art_code"]}} if parameters["art_code"] != "bad" else {"data": None}
        if parameters["stock_list"] == "2":
            raise OSError("down")
        assert "end_time" not in parameters and parameters["begin_time"] == "1996-01-01"
        return {"data": {"total_hits": 120, "list": [{"art_code": f"{parameters['stock_list']}-{parameters['page_index']}"}]}}

    codes = spark.createDataFrame([("1.SH",), ("2.SZ",)], "code string")
    request = readers.page_request(F.col("code"), F.lit(1), F.lit("1996-01-01"))
    pages = readers.fetch_pages(codes.select(F.col("code").alias("company_code"), request.alias("request")), listing, per_minute=1e6)
    assert [(r["company_code"], r["page_index"], json.loads(r["payload"])["data"]["list"][0]["art_code"]) for r in pages.collect()] == [("1.SH", i, f"1-{i}") for i in (1, 2, 3)]
    bodies = readers.fetch_contents(spark.createDataFrame([("x",), ("x",), ("bad",)], "art_code string"), listing, per_minute=1e6)
    assert {(r["art_code"], r["notice_content"], r["attach_url"]) for r in bodies.collect()} == {("x", "body x", None), ("bad", None, None)}


def test_rate_limit():
    now, waits = [0.0], []

    def wait(seconds):
        waits.append(seconds)
        now[0] += seconds

    limit = readers.RateLimit(30, clock=lambda: now[0], wait=wait)
    limit()
    now[0] += 0.5
    limit()
    now[0] += 5
    limit()
    assert waits == [1.5]


def test_registries_and_run_rows(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"group": "g", "industries": ["a", "b"]}\n{"group": "h"}\n')
    pairs = taxonomy.load_industries(str(tmp_path / "i.jsonl"), spark)
    assert pairs == [("a", "g"), ("b", "g")] and taxonomy.load_industries(str(tmp_path / "none"), spark) == []
    df = spark.createDataFrame([("a",), ("x",), (None,)], "i string")
    assert [r[0] for r in df.select(taxonomy.resolve_group(F.col("i"), pairs)).collect()] == ["g", taxonomy.DEFAULT_GROUP, taxonomy.DEFAULT_GROUP]
    one, two = stages.Run("full", "r1"), stages.Run("score", "r2", metadata={"k": 1})
    runs = one.row(spark).unionByName(two.row(spark))
    got = {r["run_id"]: r for r in stages.fail_run(stages.complete_run(runs, "r1", F.current_timestamp(), 5, 2), "r2", F.current_timestamp(), "no").collect()}
    assert (got["r1"]["status"], got["r1"]["records_processed"], got["r1"]["records_failed"], got["r1"]["run_metadata"]) == ("completed", 5, 2, None)
    assert (got["r2"]["status"], got["r2"]["error_message"], got["r2"]["records_processed"]) == ("failed", "no", 0) and got["r2"]["completed_at"] >= got["r2"]["started_at"]
    assert stages.run(["x"], {}).completed_at is not None
