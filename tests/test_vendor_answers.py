"""Filters that become a vendor's parameters, and answers that are asked for once."""

import datetime as dt
import json
import os
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage
from tidemark.plans import catalog_stored
from tidemark.sources import answers, readers

INCOME = readers.Endpoint("income", "ts_code string, end_date date, report_type string, revenue double", ("ts_code", "report_type"), "end_date")
ROWS = [(c, dt.date(2024, m, 1), k, float(m)) for c in ("A", "B", "C") for m in range(1, 13) for k in ("1", "2")]


@pytest.fixture()
def vendor(spark, tmp_path):
    """A vendor table, and the parameters of the calls it got since it was last asked."""
    log = tmp_path / "calls"

    def client(endpoint, parameters):
        with open(log, "a") as f:
            f.write(json.dumps([endpoint, parameters]) + "\n")
        start, end = parameters.get("start_date", "0"), parameters.get("end_date", "9")
        return [r for r in ROWS if all(parameters.get(n, v) == v for n, v in (("ts_code", r[0]), ("report_type", r[2]))) and start <= r[1].strftime("%Y%m%d") <= end]

    def calls():
        said = [json.loads(x) for x in log.read_text().splitlines()] if log.exists() else []
        log.unlink(missing_ok=True)
        assert all(e == "income" for e, _ in said)
        return [p for _, p in said]

    return lambda **p: readers.vendor_table(spark, client, INCOME, 6e6, **p), calls


@pytest.mark.parametrize(
    "condition, sent",
    [
        ("true", [{}]),
        ("ts_code = 'A'", [{"ts_code": "A"}]),
        ("ts_code = ''", [{}]),
        ("ts_code in ('A', 'C', 'A') and report_type = '2'", [{"report_type": "2", "ts_code": "A"}, {"report_type": "2", "ts_code": "C"}]),
        ("ts_code in ('A', 'B') and ts_code = 'B'", [{"ts_code": "B"}]),
        ("end_date >= '2024-03-01' and end_date < '2024-06-01'", [{"start_date": "20240301", "end_date": "20240531"}]),
        ("end_date > '2024-03-01' and end_date >= '2024-02-01' and end_date <= '2024-06-01'", [{"start_date": "20240302", "end_date": "20240601"}]),
        ("end_date = '2024-03-01'", [{"start_date": "20240301", "end_date": "20240301"}]),
        ("revenue > 5 and ts_code = 'A'", [{"ts_code": "A"}]),
        ("ts_code = 'A' or report_type = '1'", [{}]),
        ("ts_code <> 'A'", [{}]),
        ("ts_code like 'A%'", [{}]),
        ("upper(ts_code) = 'A' and end_date is not null", [{}]),
    ],
)
def test_filters_become_parameters_and_results_are_the_landed_table_s(spark, vendor, condition, sent):
    table, calls = vendor
    got = table().where(condition).collect()
    want = spark.createDataFrame(ROWS, INCOME.schema).where(condition).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert calls() == sent


def test_parameters_given_beforehand(vendor):
    table, calls = vendor
    assert table(ts_code="A", start_date=dt.date(2024, 11, 1), report_type="", end_date=None).where("end_date >= '2024-05-01'").count() == 4
    assert calls() == [{"ts_code": "A", "start_date": "20241101"}]


def test_long_answers_are_not_held_in_memory(tmp_path):
    """A call's answer comes whole or not at all, and neither the reader nor the landed stand-in holds all of it."""
    tries = []

    def client(endpoint, parameters):
        tries.append(1)
        for i in range(20_000):
            if len(tries) == 1 and i == 15_000:
                raise OSError("broken off")
            yield (f"A{i}", dt.date(2024, 1, 1), "x" * 2000, 1.0)

    readings = [readers.PushingReader({}, client, 6e6, INCOME), readers.VendorReader({"endpoint": "income"}, client, 6e6)]
    for reader in readings:
        tries.clear()
        tracemalloc.start()
        assert [r[0] for r in reader.read(None)] == [f"A{i}" for i in range(20_000)] and len(tries) == 2
        assert tracemalloc.get_traced_memory()[1] < 25e6
        tracemalloc.stop()
    keys = [i % 50_000 - 1 for i in range(200_000)]
    pq.write_table(pa.table({"o_custkey": keys, "o_orderdate": ["1996-01-02"] * len(keys), "o_orderstatus": ["O", "F"] * (len(keys) // 2), "o_totalprice": [1.5] * len(keys)}), tmp_path / "orders.parquet")
    client = catalog_stored._landed_client(str(tmp_path))
    tracemalloc.start()
    assert [len(list(client("income", {"ts_code": c}))) for c in ("C7", "C-1", "C0", "C07", "Cx", "")] == [4, 4, 4, 0, 0, 0]
    assert sum(1 for _ in client("income", {"report_type": "O"})) == 100_000 and tracemalloc.get_traced_memory()[1] < 25e6
    tracemalloc.stop()


def test_a_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "asked"

    def answer(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return {"text": '{"p": "%s"}' % prompt, "tokens": len(prompt), "raw": "raw"}

    asked = lambda: sorted(log.read_text().split("\n")[:-1])
    store = answers.Answers(spark, lineage.new_folder(spark, "answers"), "m1", 4)
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, prompt string")
    assert store.fill(one, "prompt", answers.parsed(answer), most=1) == 3 and asked() == ["", "a", "b"]
    two = one.unionByName(spark.createDataFrame([(6, "c")], one.schema))
    assert store.fill(two, "prompt", answers.parsed(answer)) == 1 and store.fill(two, "prompt", answer) == 0
    rows = store.answered(two, "prompt", "said")
    for _ in range(2):  # recomputed as often as need be
        assert {r["id"]: (r["said"], r["said_tokens"], r["said_error"]) for r in rows.repartition(3).collect()} == {
            1: ('{"p": "a"}', 1, None), 2: ('{"p": "b"}', 1, None), 3: ('{"p": "a"}', 1, None), 4: (None, None, None), 5: ('{"p": ""}', 0, None), 6: ('{"p": "c"}', 1, None),
        }
    assert asked() == ["", "a", "b", "c"]
    other = answers.Answers(spark, store.table.root, "m2", 4)
    assert other.fill(one, "prompt", answer) == 3 and store.fill(two, "prompt", answer) == 0
    assert store.fill(one.limit(0), "prompt", answer) == 0


def test_only_the_calls_of_a_lost_task_are_repeated(spark, tmp_path):
    """The first attempt of the task that asks for x dies after its call; Spark does not retry it in local mode, so the next fill does."""
    log, dead = tmp_path / "asked", tmp_path / "dead"

    def answer(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "x" and not dead.exists():
            dead.touch()
            os._exit(1)
        return prompt.upper()

    store = answers.Answers(spark, lineage.new_folder(spark, "answers"), "m", 4)
    df = spark.createDataFrame([(p,) for p in ("v", "x", "z")], "prompt string")
    with pytest.raises(Exception):
        store.fill(df, "prompt", answer, most=1)
    assert store.stored().count() == 0
    assert store.fill(df, "prompt", answer, most=1) == 3
    assert sorted(r["answer"] for r in store.stored().collect()) == ["V", "X", "Z"]
    n = len(log.read_text().split())
    assert store.fill(df, "prompt", answer) == 0 and len(log.read_text().split()) == n


def test_retries_errors_and_json(spark):
    tries, waits = {}, []

    def answer(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if prompt == "bad" or tries[prompt] < 3:
            raise OSError("down")
        return "[1, 2]" if prompt == "json" else "no json"

    store = answers.Answers(spark, lineage.new_folder(spark, "answers"), "m", 2)
    df = spark.createDataFrame([("json",), ("text",), ("bad",)], "prompt string")
    store.fill(df, "prompt", answers.parsed(answer), wait=waits.append)
    got = {r["prompt"]: (r["a"], r["a_error"]) for r in store.answered(df, "prompt", "a").collect()}
    assert got["json"] == ("[1, 2]", None) and got["bad"] == (None, "OSError: down") and got["text"][0] is None and got["text"][1].startswith("JSONDecodeError")
    assert store.fill(df, "prompt", lambda p: p) == 2  # errors are asked for again
    assert {r["a"] for r in store.answered(df, "prompt", "a").collect()} == {"[1, 2]", "text", "bad"}
    with pytest.raises(Exception, match="down"):
        store.fill(spark.createDataFrame([("new",)], "prompt string"), "prompt", lambda p: (_ for _ in ()).throw(OSError("down")), on=(ValueError,))


def test_batched_inference_keeps_the_order(spark):
    store = answers.Answers(spark, lineage.new_folder(spark, "answers"), "classifier", 2)
    df = spark.createDataFrame([(f"t{i}",) for i in range(50)], "text string")

    def classify(texts):
        assert 1 <= len(texts) <= 16
        return [] if "t7" in texts and len(texts) > 1 else [t + "!" for t in texts]

    assert store.fill(df, "text", classify, attempts=1, batch=16, most=40) == 50
    got = store.answered(df, "text", "label").collect()
    failed = [r["text"] for r in got if r["label"] is None]
    assert "t7" in failed and len(failed) <= 16 and all(r["label"] == r["text"] + "!" for r in got if r["text"] not in failed)
    assert store.fill(df, "text", classify, batch=1) == len(failed) and store.answered(df, "text", "label").where("label = text || '!'").count() == 50
