import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.plans import taxonomy as T

CASES = [
    # sub, fields, revenue, assets, checks
    ("earnings_annual", {"revenue_yoy_pct": "25", "net_profit_yoy_pct": "30"}, None, None, {"direction": 0.6, "surprise": 0.5, "credibility": 0.9 * 2 / 11}),
    ("earnings_q1", {"net_profit_yoy_pct": "-20"}, None, None, {"direction": -0.4}),
    ("earnings_q1", {"revenue_yoy_pct": "15"}, None, None, {"direction": 0.5}),
    ("earnings_q1", {}, None, None, {"direction": 0.0, "magnitude": 0.0, "credibility": 0.0}),
    ("equity_increase", {"increase_ratio_pct": "3"}, None, None, {"direction": 0.6, "magnitude": 0.7}),
    ("equity_decrease", {"decrease_ratio_pct": "10"}, None, None, {"direction": -1.0}),
    ("litigation", {"involved_amount": "10000"}, 0, 0, {"direction": -0.2, "magnitude": 1.0}),
    ("penalty", {"involved_amount": "0", "default_amount": "0", "penalty_amount": "25000"}, 1000000, None, {"direction": -0.5}),
    ("major_contract", {"contract_amount": "100000"}, 1000000, None, {"direction": 1.0, "magnitude": math.log10(2)}),
    ("executive_change", {}, None, None, {"magnitude": 0.0}),
    ("forecast_revision", {"revision_pct": "30"}, None, None, {"direction": 1.0, "surprise": 0.6}),
    ("earnings_h1", {"forecast_net_profit_max": "100", "net_profit": "150"}, 10**9, None, {"surprise": 0.5}),
    ("unheard_of", {}, None, None, {"direction": 0.0, "magnitude": 0.5, "credibility": 0.45}),
    ("major_contract", {"contract_amount": "100"}, None, -500, {"error_message": "magnitude: outside the logarithm"}),
    ("major_contract", {"contract_amount": "1"}, None, -500, {"magnitude": 0.0}),
    ("earnings_q1", {"net_profit_yoy_pct": ("15%", "text")}, None, None, {"error_message": "direction: not a number"}),
    ("bid_win", {"bid_amount": ("15%", "text"), "revenue": "10"}, 1000, None, {"magnitude": math.log10(1.1), "error_message": None}),
    ("earnings_q1", {"net_profit_yoy_pct": "True"}, None, None, {"direction": 0.0, "credibility": 0.0}),
    (None, {}, None, None, {"error_message": "Missing classification", "composite_score": None}),
]


@pytest.fixture(scope="module")
def scored(spark):
    a = spark.createDataFrame([(i, i) for i in range(len(CASES))], "id long, company_id long")
    c = spark.createDataFrame([(i, None, s) for i, (s, *_) in enumerate(CASES) if s], "announcement_id long, major_category string, sub_category string")
    co = spark.createDataFrame([(i, r, n) for i, (_, _, r, n, _) in enumerate(CASES)], "id long, annual_revenue long, net_assets long")
    eav = [(i, k, *(v if isinstance(v, tuple) else (v, "numeric")), i) for i, (_, f, *_) in enumerate(CASES) for k, v in f.items()]
    f = spark.createDataFrame(eav, "announcement_id long, field_name string, field_value string, field_type string, n int")
    return {r["announcement_id"]: r for r in scoring.score(a, c, co, scoring.field_map(f, F.col("n"))).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(scored, i):
    for name, value in CASES[i][4].items():
        got = scored[i][name]
        assert got == pytest.approx(value) if isinstance(value, float) else got == value, (CASES[i], name)


def test_composite_is_the_product(scored):
    for r in scored.values():
        if r["error_message"] is None:
            assert r["composite_score"] == pytest.approx(r["direction"] * r["magnitude"] * r["surprise"] * r["credibility"])
            assert r["processing_status"] == "scored" and '"direction"' in r["scoring_detail"]
        else:
            assert r["processing_status"] == "failed" and r["scoring_detail"] is None


def test_random_directions_against_python(spark):
    r, rows, want = random.Random(3), [], {}
    events = {e.sub: e for e in T.events()}
    clamp = lambda v, a, b: max(a, min(b, v))
    for i in range(300):
        sub = r.choice(sorted(events))
        f = {k: r.choice([None, -120, -3, 0, 2, 7, 40000]) for k in ("net_profit_yoy_pct", "revenue_yoy_pct", "revision_pct", "increase_ratio_pct", "decrease_ratio_pct", "contract_amount", "involved_amount", "default_amount", "penalty_amount")}
        d = events[sub].baseline
        if sub.startswith("earnings_"):
            if f["net_profit_yoy_pct"] is not None:
                d = clamp(f["net_profit_yoy_pct"] / 50, -1, 1)
            elif f["revenue_yoy_pct"] is not None:
                d = clamp(f["revenue_yoy_pct"] / 30, -1, 1)
        elif sub in T.RISK_SUBS:
            loss = f["involved_amount"] or f["default_amount"] or f["penalty_amount"]
            d = d if loss is None else clamp(-loss / 50000, -1, 0)
        else:
            for s, k, by, low, high in (("forecast_revision", "revision_pct", 20, -1, 1), ("equity_increase", "increase_ratio_pct", 5, 0, 1), ("equity_decrease", "decrease_ratio_pct", -5, -1, 0), ("major_contract", "contract_amount", 100000, 0, 1)):
                if sub == s and f[k] is not None:
                    d = clamp(f[k] / by, low, high)
        want[i] = clamp(d, -1, 1)
        rows += [(i, sub, k, None if v is None else str(v)) for k, v in f.items()]
    df = spark.createDataFrame(rows, "announcement_id long, sub_category string, field_name string, field_value string").withColumn("field_type", F.lit("numeric"))
    ids = df.select("announcement_id", "sub_category").distinct()
    a = ids.select(F.col("announcement_id").alias("id"), F.lit(0).cast("long").alias("company_id"))
    co = spark.createDataFrame([(0, 10**12, None)], "id long, annual_revenue long, net_assets long")
    got = scoring.score(a, ids.withColumn("major_category", F.lit("A")), co, scoring.field_map(df, F.col("field_value")))
    assert {r["announcement_id"]: r["direction"] for r in got.collect()} == pytest.approx(want)
