import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, extraction, labelling, report, search, stats, upsert
from tidemark.operators.search import Filters
from tidemark.plans import stages
from tidemark.plans import taxonomy as T


def test_taxonomy_counts():
    ev = T.events()
    assert (len({e.major for e in ev}), len(ev), sum(len(e.fields) for e in ev), len({f for e in ev for f in e.fields})) == (7, 30, 186, 150)
    ind = T.industries()
    assert len(ind) == 110 == len({i for i, _ in ind}) and len({g for _, g in ind}) == 18


def test_resolve_group(one):
    got = [one(T.resolve_group(F.col("x")), x=v) for v in ("白酒", "半导体", "nothing", "", None)]
    assert got == ["消费", "科技", T.DEFAULT_GROUP, T.DEFAULT_GROUP, T.DEFAULT_GROUP]


@pytest.fixture(scope="module")
def market(spark):
    a = spark.createDataFrame(
        [(1, 1, "ANN-A", "Quarterly 50% report", "b", "2024-04-25", "reported", None), (2, 1, "ANN-B", "Penalty notice", None, "2024-04-26", "scored", None), (3, None, "ANN-C", "Other", "", "2024-04-26", "scored", None)],
        "id long, company_id long, announcement_id string, title string, full_text string, d string, processing_status string, error_message string",
    ).withColumn("published_date", F.to_date("d")).drop("d")
    c = spark.createDataFrame([(1, "A", "earnings_q1", 0.92, "银行", "金融"), (2, "F", "penalty", 0.80, None, None)], "announcement_id long, major_category string, sub_category string, confidence double, industry string, industry_group string")
    s = spark.createDataFrame([(1, 0.102, 1.0, 1.0, 1.0, 0.102), (2, -0.6, 1.0, 1.0, 1.0, -0.6), (3, 0.1, 1.0, 1.0, 1.0, 0.1)], "announcement_id long, direction double, magnitude double, surprise double, credibility double, composite_score double")
    co = spark.createDataFrame([(1, "000001.SZ", "Bank", "银行", True)], "id long, stock_code string, stock_name string, industry string, is_tracked boolean")
    return a, c, s, co


@pytest.mark.parametrize(
    "f, ids",
    [({}, {1, 2, 3}), ({"keyword": "penalty"}, {2}), ({"keyword": "50%"}, {1}), ({"status": "scored"}, {2, 3}), ({"direction": "bullish"}, {1}), ({"direction": "bearish"}, {2}), ({"direction": "odd"}, {3}),
     ({"industry_group": "金融"}, {1}), ({"major_category": "F"}, {2}), ({"keyword": ""}, {1, 2, 3}), ({"keyword": "zzz"}, set())],
)
def test_filters(market, f, ids):
    a, c, s, _ = market
    assert {r["id"] for r in search.filtered(a, c, s, Filters(**f)).collect()} == ids


def test_paging(market):
    a, c, s, _ = market
    assert [r["id"] for r in search.search(a, c, s, Filters(), 1, 2).orderBy(F.desc("id")).collect()] == [3, 2]
    assert [(r["id"], r["direction"]) for r in search.search(a, c, s, Filters(), 2, 2).collect()] == [(1, "bullish")]
    assert search.page_bounds(0, 0) == (1, 1) and search.page_bounds(5, 1000) == (5, 100)
    assert tuple(search.count_pages(a, 2).first()) == (3, 2) and tuple(search.count_pages(a.limit(0)).first()) == (0, 1)


def test_stats_with_nothing(market):
    a, c, s, _ = market
    assert [r["n"] for r in stats.status_overview(a.limit(0)).orderBy("place").collect()] == [0] * 7
    assert {r["direction"]: r["n"] for r in stats.direction_distribution(s.limit(0)).collect()} == {"bullish": 0, "bearish": 0, "neutral": 0}
    assert tuple(stats.report_totals(s).first()) == (3, 1, 1, 1, 1)


def test_report(market):
    a, c, s, co = market
    rows = report.items(a, s, c, co)
    text = report.markdown(rows, "2024-04-26").first()["text"]
    assert "**公告总数**: 3" in text and "- **F-penalty**: 1 条" in text and "-0.600" in text and "暂不可用" in text
    assert report.summary(rows, "2024-04-26").first()["summary_text"].startswith("2024-04-26 共处理 3 条公告，其中 1 条高影响事件。 最高评分: Penalty notice...")
    none = rows.where("composite_score > 5")
    assert "今日无高影响事件" in report.markdown(none, "d").first()["text"] and "无高影响事件" in report.summary(none, "d").first()["summary_text"]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, w string")
    new = spark.createDataFrame([("a", None, "y"), ("c", 3, "z")], "k string, v int, w string")
    merged = upsert.merge_non_null(old, new, ["k"])
    want = {("a", 1, "y"), ("b", 2, None), ("c", 3, "z")}
    assert {tuple(r) for r in merged.collect()} == want
    assert {tuple(r) for r in upsert.merge_non_null(merged, new, ["k"]).collect()} == want  # twice is once
    assert {tuple(r) for r in upsert.replace(old, new, ["k"]).collect()} == {("a", None, "y"), ("b", 2, None), ("c", 3, "z")}
    assert [r["k"] for r in upsert.inserted(old, new, ["k"]).collect()] == ["c"]
    nulls = spark.createDataFrame([(None, 5, None)], "k string, v int, w string")
    assert {tuple(r) for r in upsert.merge_non_null(nulls, spark.createDataFrame([(None, 6, "n")], "k string, v int, w string"), ["k"]).collect()} == {(None, 6, "n")}
    repeated = spark.createDataFrame([("a", 7, "p", 1), ("a", 8, "q", 2)], "k string, v int, w string, n int")
    assert {tuple(r) for r in upsert.merge_non_null(old, repeated, ["k"], order="n").collect()} == {("a", 8, "q"), ("b", 2, None)}
    twice = spark.createDataFrame([("a", 8, "p"), ("a", 9, None), ("d", None, "x"), ("d", None, "y")], "k string, v int, w string")  # without an order: the greatest row
    assert {tuple(r) for r in upsert.replace(old, twice, ["k"]).collect()} == {("a", 9, None), ("b", 2, None), ("d", None, "y")}


def _sequential(rows):
    ids, texts, kept = set(), set(), []
    for place, i, t in rows:
        key = i or "text:" + t
        if key in ids or t in texts:
            continue
        ids.add(key)
        texts.add(t)
        kept.append(place)
    return kept


@pytest.mark.parametrize("rows", [[("A", "t1"), ("A", "t2"), ("B", "t2"), ("C", "t2")], [("A", "t1"), ("B", "t1"), ("B", "t2")], [("", "t1"), ("", "t1"), ("X", "t1")]])
def test_first_wins_small(spark, rows):
    rows = [(n, *r) for n, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "place int, announcement_id string, text string")
    assert sorted(r["place"] for r in labelling.first_wins(df).collect()) == _sequential(rows)


def test_first_wins_random(spark):
    r = random.Random(1)
    rows = [(n, r.choice(["", *"abcdefgh"]), r.choice("uvwxyz") * r.randint(1, 3)) for n in range(120)]
    df = spark.createDataFrame(rows, "place int, announcement_id string, text string")
    assert sorted(x["place"] for x in labelling.first_wins(df).collect()) == _sequential(rows)


def test_first_wins_walks_components_and_splits_large_ones(spark):
    r = random.Random(5)
    rows = [(n, r.choice(["", f"i{r.randrange(30)}"]), f"t{r.randrange(40)}") for n in range(60)]
    chains = [(1000 + 100 * c + n, f"c{c}-{n // 2}", f"u{c}-{(n + 1) // 2}") for c, size in enumerate((12, 5, 6, 4)) for n in range(size)]
    df = spark.createDataFrame(rows + chains, "place int, announcement_id string, text string").repartition(3)
    got = labelling.first_wins(df, walk=8)
    assert sorted(x["place"] for x in got.collect()) == _sequential(rows + chains)
    assert labelling.first_wins(df.limit(0), walk=0).count() == 0
    parts = labelling._components(df.selectExpr("place as _o", "announcement_id as _k", "text as _t").where("place >= 1000"))
    assert sorted(n for (n,) in parts.groupBy("_c").count().select("count").collect()) == [4, 5, 6, 12]


def test_a_long_chain_takes_few_jobs(spark):
    """10,000 rows, each of which hangs on the one before: by rounds alone 5,000 rounds."""
    rows = [(n, f"i{n // 2}", f"t{(n + 1) // 2}") for n in range(10_000)]
    df = spark.createDataFrame(rows, "place int, announcement_id string, text string")
    spark.sparkContext.setJobGroup("chain", "")
    got = sorted(x["place"] for x in labelling.first_wins(df).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 20, jobs
    assert got == _sequential(rows)



def test_merge_counts(spark):
    schema = "announcement_id string, text string, sub_category string, major_category string, place int"
    a = spark.createDataFrame([("1", "t", "buyback", None, 0), ("1", "u", "buyback", None, 1), ("2", "", "penalty", None, 2), ("3", "v", "nonsense", None, 3)], schema)
    _, counts = labelling.merge([a, a.limit(1)])
    assert counts == {"merged": 1, "skipped": 3, "invalid": 1}


def test_extraction_typing(spark):
    js = '{"revenue": 1.5, "eps": true, "roe": null, "summary": "x", "key_entities": ["a"], "other": {"k": 1}, "net_margin": "12%"}'
    df = spark.createDataFrame([(1, "earnings_q1", js), (2, "who", '{"other": {"k": 1}}'), (3, "earnings_q1", "[]"), (4, "earnings_q1", None), (5, "earnings_q1", "nope")], "announcement_id long, sub_category string, result string")
    got = {(r["announcement_id"], r["field_name"]): (r["field_value"], r["field_type"]) for r in extraction.to_fields(df).collect()}
    assert got == {
        (1, "revenue"): ("1.5", "numeric"), (1, "eps"): ("True", "numeric"), (1, "roe"): (None, "text"), (1, "summary"): ("x", "text"), (1, "key_entities"): ('["a"]', "json"), (1, "net_margin"): ("12%", "text"), (2, "other"): ('{"k":1}', "text"),
    }


def test_gate_at_the_threshold(spark):
    df = spark.createDataFrame([(1, 0.6), (2, 0.5999), (3, 0.9)], "announcement_id long, confidence double")
    assert [r[0] for r in extraction.gated(df, limit=1).collect()] == [1]


def test_calibration(spark):
    edge = spark.createDataFrame([(c, True) for c in (0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 1.0)], "confidence double, correct boolean")
    bins = [r[0] for r in edge.select(calibration.ece_bin(F.col("confidence"))).collect()]
    import numpy as np

    assert bins == [min(9, int(np.searchsorted(np.asarray([i * 0.1 for i in range(1, 10)]), c, "right"))) for c in (0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 1.0)]
    assert calibration.ece(spark.createDataFrame([(0.8, True), (0.8, False)], "confidence double, correct boolean")).first()[0] == pytest.approx(0.3)
    rows = spark.createDataFrame([([2.0, 1.0], 0), ([0.0, 3.0], 1), ([1.0, 0.5], 1)], "logits array<double>, label int")
    best = calibration.best_temperature(calibration.temperature_search(rows)).first()
    assert 0.1 <= best["temperature"] <= 1.0
    assert calibration.valid_temperature(None) == calibration.valid_temperature(-1) == 1.0


def test_status_machine(spark, market):
    a, c, s, co = market
    a = a.withColumn("processing_status", F.lit("fetched"))
    a = stages.preprocess(a)
    assert {r["id"]: r["full_text"] for r in a.collect()} == {1: "b", 2: "Penalty notice", 3: "Other"}
    p = spark.createDataFrame([(1, "earnings_q1", 0.9), (2, "mystery", 0.3)], "announcement_id long, sub_category string, confidence double")
    a, made = stages.classify(a, p, co)
    assert {(r["announcement_id"], r["major_category"], r["industry_group"]) for r in made.collect()} == {(1, "A", "金融"), (2, "?", "金融")}
    a = stages.extract(a, made, p.select("announcement_id"))
    assert {r["id"]: r["processing_status"] for r in a.collect()} == {1: "extracted", 2: "classified", 3: "preprocessed"}


def test_runs(spark):
    done = stages.run(["a", "b", "zzz"], {"a": lambda: (3, 1), "b": lambda: (2, 0)})
    assert (done.status, done.records_processed, done.records_failed, done.run_type) == ("completed", 5, 1, "a")
    broken = stages.run(["a", "b"], {"a": lambda: 1 / 0})
    assert broken.status == "failed" and broken.error_message.startswith("a:")
    assert done.row(spark).first()["status"] == "completed"


def test_seeking_equals_offsets_at_every_page(spark):
    r = random.Random(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(r.randrange(9)) for _ in range(95)] + [None] * 12
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id long, published_date date").repartition(5)
    order = sorted(range(len(days)), key=lambda i: (days[i] is None, -(days[i] or dt.date(1, 1, 1)).toordinal(), -i))
    starts = search.page_starts(df, 10).cache()
    assert {x["page"]: x["id"] for x in starts.collect()} == {k + 1: order[10 * k] for k in range(11)}
    for number in (1, 2, 9, 10, 11, 12):
        want = order[10 * (number - 1) : 10 * number]
        assert [x["id"] for x in search.deep_page(df, starts, number, 10).collect()] == want
        if want:
            assert [x["id"] for x in search.page_after(df, days[want[-1]], want[-1], 10).collect()] == order[10 * number : 10 * number + 10]
    plan = search.page_after(df, days[order[50]], order[50], 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan
    assert search.page_starts(df.limit(0), 10).count() == 0


def test_seed_rows_fill_longer_names_first(spark):
    templates = spark.createDataFrame([("a", "{n}-{n2}", "{n}+{n}"), ("a", "{n}-{n2}", "{n}+{n}"), ("b", None, "x"), (None, "t", "u")], "sub_category string, title string, body string")
    got = {(x["sub_category"], x["i"]): x["text"] for x in labelling.seed_rows(templates, {"n": (1, 3), "n2": ["zz"]}, each=5).collect()}
    assert len(got) == 10 and all(got["b", i] == "\nx" for i in range(5))
    for i in range(5):
        title, body = got["a", i].split("\n")
        assert title.endswith("-zz") and title[0] in "123" and body[0] == body[2] and body[1] == "+"
    again = labelling.seed_rows(templates.repartition(3), {"n2": ["zz"], "n": (1, 3)}, each=5)
    assert {(x["sub_category"], x["i"]): x["text"] for x in again.collect()} == got
