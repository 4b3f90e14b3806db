import pytest

from tidemark.sources import models


def test_json_answers(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "i int, text string")
    answer = lambda t: '{"a": 1}' if t == "good" else "no json"
    got = {r["i"]: r["out"] for r in models.json_answers(df, "text", "out", answer, wait=lambda s: None).collect()}
    assert got == {1: '{"a": 1}', 2: None}


def test_narratives(spark):
    df = spark.createDataFrame([(1, "t", "penalty", 0.5), (2, None, None, -0.7)], "announcement_id long, title string, sub_category string, composite_score double")

    def answer(text):
        if "?" in text:
            raise ValueError
        return text.upper()

    got = {r["announcement_id"]: r["narrative"] for r in models.narratives(df, answer).collect()}
    assert got == {1: "T | PENALTY | +0.500", 2: None}


def test_classifier(spark, tmp_path):
    rows = [("利润 增长 百分 " + str(i), "earnings_q1") for i in range(20)] + [("股份 回购 计划 " + str(i), "buyback") for i in range(20)]
    df = spark.createDataFrame(rows, "text string, sub_category string")
    model = models.train_classifier(df, 1 << 10, 20)
    model.write().overwrite().save(str(tmp_path / "m"))
    got = models.predict(models.require_model(str(tmp_path / "m")), spark.createDataFrame([("回购 股份",), ("利润 增长",)], "text string"), 0.5).collect()
    assert [r["sub_category"] for r in got] == ["buyback", "earnings_q1"] and all(0.5 <= r["confidence"] <= 1 for r in got)
    with pytest.raises(FileNotFoundError):
        models.require_model(str(tmp_path / "none"))
