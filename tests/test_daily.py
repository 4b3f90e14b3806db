"""The incremental fetch and the daily run: days, repeated batches, runs that break off and go on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage
from tidemark.plans import daily
from tidemark.sources import answers
from tidemark.streaming import incremental

DAY = dt.date(2024, 5, 1)


def day(n):
    return DAY + dt.timedelta(n)


def test_days_and_offsets():
    reader = lambda target, lookback=0: incremental.DayReader({"start": "2024-05-01", "target": target, "lookback": lookback})
    r = reader("2024-05-03", 2)
    first, last = r.initialOffset(), r.latestOffset()
    assert (first, last) == ({"next": "2024-05-01"}, {"next": "2024-05-04"})
    (part,) = r.partitions(first, last)
    assert [d for (d,) in r.read(part)] == [day(n) for n in range(-2, 3)]
    assert r.partitions(last, last) == [] and r.partitions(last, first) == []
    assert reader("2020-01-01").latestOffset() == {"next": "2024-05-01"}


def test_each_day_is_staged_once_and_an_unfinished_batch_again(spark):
    folder, seen, broken = lineage.new_folder(spark, "days"), [], [True]

    def stage(first, last, number):
        seen.append((first, last, number))
        if broken[0]:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        incremental.run_days(spark, DAY, day(1), 1, folder, stage)
    broken[0] = False
    incremental.run_days(spark, DAY, day(1), 1, folder, stage)
    incremental.run_days(spark, DAY, day(1), 1, folder, stage)  # nothing new
    incremental.run_days(spark, DAY, day(4), 1, folder, stage)
    assert seen == [(day(-1), day(1), 0), (day(-1), day(1), 0), (day(1), day(4), 1)]


@pytest.fixture()
def landed(spark):
    items = [("000001", 1, i, f"A{i}", f"t{i}", str(day(i)), "s") for i in range(4)] + [("000001", 1, 9, "", "no code", str(DAY), "s"), ("000002", 1, 1, "B1", "untracked", str(DAY), "s")]
    companies = [(1, "000001.SZ", "One", "银行", True), (2, "000002.SZ", "Two", "", False)]
    return (
        spark.createDataFrame(items, "company_code string, page_index int, item_index int, art_code string, title string, notice_date string, notice_content string"),
        spark.createDataFrame([("A1", "<p>body</p>", "", "u")], "art_code string, notice_content string, attach_url_web string, attach_url string"),
        spark.createDataFrame(companies, "id long, stock_code string, stock_name string, industry string, is_tracked boolean"),
    )


def fields_of(rows):
    return rows.select(F.col("id").alias("announcement_id"), F.lit("amount").alias("field_name"), F.lit("12").alias("field_value"), F.lit("numeric").alias("field_type"))


def steps_of(landed, target, calls, fail=()):
    items, contents, companies = landed
    fail = list(fail)

    def predict(rows):
        calls.append("predict")
        return rows.select(F.col("id").alias("announcement_id"), F.lit("buyback").alias("sub_category"), F.lit(0.9).alias("confidence"))

    asked = answers.Answers(companies.sparkSession, lineage.new_folder(companies.sparkSession, "answers"), "m", 1)
    steps = {
        "fetch": daily.fetch_step(items, contents, companies, DAY, target, 0), "preprocess": daily.preprocess_step, "classify": daily.classify_step(predict, companies),
        "extract": daily.extract_step(fields_of), "score": daily.score_step(companies.withColumns({"annual_revenue": F.lit(100).cast("long"), "net_assets": F.lit(50).cast("long")})), "report": daily.report_step(companies, target, asked, lambda prompt: f"about {prompt}"),
    }

    def wrapped(name):
        def step(store, number):
            if (name, "before") in fail:
                fail.remove((name, "before"))
                raise RuntimeError(f"{name} lost before")
            done = steps[name](store, number)
            if (name, "after") in fail:
                fail.remove((name, "after"))
                raise RuntimeError(f"{name} lost after")
            return done

        return step

    return {name: wrapped(name) for name in steps}


def state(store):
    a = store["announcements"].read().select("announcement_id", "full_text", "published_date", "processing_status", "error_message")
    tables = [a, store["classifications"].read().drop("classified_at"), store["scores"].read().select("announcement_id", "composite_score"), store["daily_reports"].read()]
    return [sorted(map(str, t.collect())) for t in tables]


def test_a_broken_run_resumed_equals_a_whole_one(spark, landed):
    whole, broken = (daily.Store(spark, lineage.new_folder(spark, "store"), 2) for _ in range(2))
    assert daily.run(whole, day(3), steps_of(landed, day(3), [])).status == "completed"
    calls = []
    steps = steps_of(landed, day(3), calls, [("fetch", "after"), ("classify", "after"), ("score", "before"), ("report", "after")])
    said = []
    while (made := daily.run(broken, day(3), steps)).status == "failed":
        said.append(made.error_message)
    assert said == ["fetch: fetch lost after", "classify: classify lost after", "score: score lost before", "report: report lost after"]
    assert state(broken) == state(whole)
    assert [len(s) for s in state(whole)] == [4, 4, 4, 1] and all("reported" in a or "scored" in a for a in state(whole)[0])
    runs = sorted((r["status"], r["run_type"], r["records_failed"]) for r in broken["runs"].read().collect())
    assert runs == [("completed", "full", 0)]
    assert calls == ["predict"] * 2  # once a try of the stage


def test_a_completed_run_is_not_resumed_and_unknown_stages_are_skipped(spark, landed):
    store = daily.Store(spark, lineage.new_folder(spark, "store"), 2)
    steps = steps_of(landed, day(0), [])
    one = daily.run(store, day(0), steps, ["fetch", "unheard", "preprocess"])
    two = daily.run(store, day(0), steps, ["fetch", "unheard", "preprocess"])
    assert (one.status, one.run_type, one.records_processed, one.metadata["done"]) == ("completed", "fetch", 2, ["fetch", "preprocess"])
    assert two.run_id != one.run_id and two.metadata["number"] == 2 and two.records_processed == 0
    assert store["announcements"].read().select("announcement_id", "full_text", "processing_status").collect() == [("A0", "s", "preprocessed")]
