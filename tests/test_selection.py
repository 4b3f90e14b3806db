import random

import duckdb
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import selection


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, f"class {i % 3}", [rng.gauss(2.0 * (j == i % 3), 1.0) for j in range(4)]) for i in range(300)]
    data.append((300, None, [0.0] * 4))
    df = spark.createDataFrame(data, "id long, name string, v array<double>")
    return selection.split_labelled(df, "name", "id").withColumn("features", array_to_vector("v"))


def figures_in_sql(predicted):
    con = duckdb.connect()
    con.register("predicted", predicted.toPandas())
    return con.sql("""WITH n AS (SELECT label_id AS c FROM predicted UNION SELECT prediction FROM predicted),
        f AS (SELECT c, count(*) FILTER (label_id = c AND prediction = c) AS hit, count(*) FILTER (label_id = c) AS t, count(*) FILTER (prediction = c) AS p FROM n, predicted GROUP BY c)
        SELECT avg(2.0 * hit / (t + p)), sum(hit) / sum(t) FROM f""").fetchall()[0]


def test_split_and_labels(rows):
    assert rows.count() == 300 and rows.columns == ["id", "name", "v", "split", "label_id", "features"]
    assert {(r[0], r[1]) for r in rows.select("name", "label_id").distinct().collect()} == {(f"class {i}", i) for i in range(3)}
    assert {tuple(r) for r in rows.groupBy("name", "split").count().collect()} == {(f"class {i}", s, n) for i in range(3) for s, n in (("train", 70), ("validation", 15), ("test", 15))}


def test_best_round_is_kept_and_its_figures_are_right(spark, rows, tmp_path):
    done = selection.Selection(spark, f"file://{tmp_path}", rounds=4, steps=3).fit(rows, label="label_id")
    said, best = done.history(), done.best()
    assert [r["round"] for r in said] == list(range(1, len(said) + 1)) and best["macro_f1"] == max(r["macro_f1"] for r in said) > 0.6
    assert {p.name for p in (tmp_path / "weights").iterdir()} == {str(best["round"]), str(said[-1]["round"])}
    macro, accuracy = figures_in_sql(done.model().transform(rows.where("split = 'validation'")).select(F.col("label_id").cast("double"), "prediction"))
    assert best["macro_f1"] == pytest.approx(macro) and best["accuracy"] == pytest.approx(accuracy)


def test_rounds_go_on_from_the_last_weights(spark, rows, tmp_path):
    train = rows.where("split = 'train'").select(F.col("label_id").cast("double").alias("label"), "features")
    one = selection.Selection(spark, f"file://{tmp_path}", steps=2)
    first = one._round(train, [4, 3], None)
    again = one._round(train, [4, 3], first.weights)
    right = lambda m: m.transform(train).where("prediction = label").count()
    assert right(again) >= right(first) - 5 and list(again.weights) != list(first.weights)


def test_patience_and_resuming(spark, rows, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    fitted = []
    plain = selection.Selection._round
    monkeypatch.setattr(selection.Selection, "_round", lambda self, *a: fitted.append(a[2] is None) or plain(self, *a))
    judged, averages = [], selection.calibration.averages

    def breaking(report):
        judged.append(1)
        if len(judged) == 2:
            raise RuntimeError("lost")  # the run breaks off after the second round's weights, before its figures
        return averages(report)

    monkeypatch.setattr(selection.calibration, "averages", breaking)
    with pytest.raises(RuntimeError):
        selection.Selection(spark, folder, steps=2).fit(rows, label="label_id")
    done = selection.Selection(spark, folder, rounds=20, patience=2, steps=40).fit(rows, label="label_id")
    said, best = done.history(), done.best()
    assert fitted[:3] == [True, False, False] and len(said) < 20 and said[-1]["round"] == best["round"] + 2  # two rounds without a better one end it
    n = len(fitted)
    done.fit(rows, label="label_id")
    assert len(fitted) == n  # a finished training is not begun again


def test_nothing_to_learn(spark, rows, tmp_path):
    for i, df in enumerate((rows.limit(0), rows.where("label_id = 0"), rows.where("split <> 'validation'"))):
        with pytest.raises(ValueError):
            selection.Selection(spark, f"file://{tmp_path}/{i}").fit(df, label="label_id")
