"""The rule engine: direction, magnitude, surprise, credibility and their product, as one lazy plan.

Fields come as a map from name to (number, bad): `bad` marks a text that says no number, which fails the row if a rule has to
read it, while amounts skip it. Nothing is collected and no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, safe_divide, to_double, value_as_float
from ..plans import taxonomy as T

VERSION = "v1.0"


def field_map(fields: DataFrame, order: Column, most_recent: bool = True, laid_out: bool = False) -> DataFrame:
    """EAV rows (announcement_id, field_name, field_value, field_type) to one map a row's announcement; of repeated names the last by `order`.

    One exchange by announcement serves both groupings, and the join that follows; rows `laid_out` in buckets of announcements need none.
    """
    pick = F.max_by if most_recent else F.min_by
    one = (fields if laid_out else fields.repartition("announcement_id")).groupBy("announcement_id", "field_name").agg(pick(F.struct("field_value", "field_type"), order).alias("f"))
    number = F.when(F.col("f.field_type") == "numeric", value_as_float(F.col("f.field_value"))).otherwise(to_double(F.col("f.field_value")))
    bad = (F.col("f.field_type") != "numeric") & F.col("f.field_value").isNotNull() & number.isNull()
    present = F.when(F.col("f.field_type") == "numeric", number.isNotNull()).otherwise(F.col("f.field_value").isNotNull())
    truthy = F.when(F.col("f.field_type") == "numeric", F.coalesce(number != 0, F.lit(False))).otherwise(F.coalesce(F.col("f.field_value") != "", F.lit(False)))
    value = F.struct(number.alias("v"), bad.alias("bad"), present.alias("present"), truthy.alias("truthy"))
    return one.groupBy("announcement_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", value.alias("value")))).alias("fields"))


def _get(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def _present(name: str) -> Column:
    return F.coalesce(_get(name)["present"], F.lit(False))


def direction(sub: Column, baseline: Column) -> tuple[Column, Column]:
    """(value, failed): how good or bad the event is, from -1 to 1; 0 for an unknown sub-category."""
    profit, revenue = _get("net_profit_yoy_pct"), _get("revenue_yoy_pct")
    risk = [_get(n) for n in ("involved_amount", "default_amount", "penalty_amount")]
    truthy = [F.coalesce(r["truthy"], F.lit(False)) for r in risk]
    loss = F.when(truthy[0], risk[0]).when(truthy[1], risk[1]).otherwise(risk[2])
    has_loss = truthy[0] | truthy[1] | _present("penalty_amount")
    rules = [
        (sub.startswith("earnings_") & _present("net_profit_yoy_pct"), profit, lambda v: clamp(v / 50.0, -1.0, 1.0)),
        (sub.startswith("earnings_") & _present("revenue_yoy_pct"), revenue, lambda v: clamp(v / 30.0, -1.0, 1.0)),
        ((sub == "forecast_revision") & _present("revision_pct"), _get("revision_pct"), lambda v: clamp(v / 20.0, -1.0, 1.0)),
        ((sub == "equity_increase") & _present("increase_ratio_pct"), _get("increase_ratio_pct"), lambda v: clamp(v / 5.0, 0.0, 1.0)),
        ((sub == "equity_decrease") & _present("decrease_ratio_pct"), _get("decrease_ratio_pct"), lambda v: clamp(-v / 5.0, -1.0, 0.0)),
        ((sub == "major_contract") & _present("contract_amount"), _get("contract_amount"), lambda v: clamp(v / 100000.0, 0.0, 1.0)),
        (sub.isin(*T.RISK_SUBS) & has_loss, loss, lambda v: clamp(-v / 50000.0, -1.0, 0.0)),
    ]
    value, failed = F.when(baseline.isNull(), F.lit(T.DEFAULTS["direction"])), F.when(baseline.isNull(), F.lit(False))
    for applies, field, rule in rules:
        value, failed = value.when(applies, rule(field["v"])), failed.when(applies, field["bad"])
    return clamp(value.otherwise(baseline), -1.0, 1.0), failed.otherwise(False)


def amount() -> Column:
    """The first of the amount fields that says a number."""
    return F.coalesce(*[_get(n)["v"] for n in T.AMOUNT_FIELDS])


def magnitude(baseline: Column, has_company: Column, revenue: Column, assets: Column) -> tuple[Column, Column]:
    """(value, failed): the amount relative to the company's size on a logarithmic scale, from 0 to 1."""
    base = F.coalesce(F.nullif(revenue, F.lit(0)), F.nullif(assets, F.lit(0)), F.lit(1)).cast("double")
    inside = 1.0 + safe_divide(F.abs(amount()), base) * 10.0
    counted = amount().isNotNull() & has_company
    plain = F.coalesce(F.abs(baseline), F.lit(T.DEFAULTS["magnitude"]))
    return F.when(counted, clamp(F.log10(F.when(inside > 0, inside)))).otherwise(plain), F.coalesce(counted & (inside <= 0), F.lit(False))


def surprise(sub: Column) -> tuple[Column, Column]:
    """(value, failed): the distance from what was forecast, from 0 to 1; 0.5 where nothing says."""
    pct, said, was = _get("revision_pct"), _get("forecast_net_profit_max"), _get("net_profit")
    revised = (sub == "forecast_revision") & _present("revision_pct")
    told = sub.startswith("earnings_") & _present("forecast_net_profit_max") & _present("net_profit")
    value = F.when(revised, clamp(F.abs(pct["v"]) / 50.0)).when(told, clamp(safe_divide(F.abs(was["v"] - said["v"]), F.abs(said["v"]))))
    return value.otherwise(F.lit(T.DEFAULTS["surprise"])), F.when(revised, pct["bad"]).when(told, said["bad"] | was["bad"]).otherwise(False)


def completeness(expected: Column) -> Column:
    """The share of a sub-category's expected fields that are there."""
    filled = F.size(F.filter(expected, lambda f: F.coalesce(F.try_element_at(F.col("fields"), f)["present"], F.lit(False))))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) > 0, filled / F.size(expected)).otherwise(0.5)


def credibility(expected: Column, source: str = "company_announcement") -> Column:
    return clamp(F.lit(T.SOURCE_CREDIBILITY.get(source, 0.90)) * completeness(expected))


def score(announcements: DataFrame, classifications: DataFrame, companies: DataFrame, fields: DataFrame) -> DataFrame:
    """One row an announcement: the four dimensions, the composite, the detail as JSON, and the new status with its error.

    `fields` is field_map()'s output. The taxonomy is 30 rows, so its lookup is a literal; the facts are joined on their keys, and
    Spark chooses how.
    """
    spark = announcements.sparkSession
    a = announcements.select(F.col("id").alias("announcement_id"), "company_id")
    c = classifications.select("announcement_id", "major_category", "sub_category")
    co = companies.select(F.col("id").alias("company_id"), "annual_revenue", "net_assets", F.lit(True).alias("_co"))
    ev = F.broadcast(T.events_df(spark).select(F.col("sub").alias("sub_category"), "direction_baseline", F.col("fields").alias("expected")))
    df = a.join(c, "announcement_id", "left").join(fields, "announcement_id", "left").join(co, "company_id", "left").join(ev, "sub_category", "left")
    sub, base = F.coalesce("sub_category", F.lit("")), F.col("direction_baseline")
    d, d_bad = direction(sub, base)
    m, m_bad = magnitude(base, F.coalesce("_co", F.lit(False)), F.col("annual_revenue"), F.col("net_assets"))
    s, s_bad = surprise(sub)
    error = F.when(F.col("sub_category").isNull(), "Missing classification").when(d_bad, "direction: not a number").when(m_bad, "magnitude: outside the logarithm").when(s_bad, "surprise: not a number")
    df = df.select("announcement_id", "major_category", "sub_category", d.alias("direction"), m.alias("magnitude"), s.alias("surprise"), credibility(F.col("expected")).alias("credibility"), error.alias("error_message"), amount().alias("amount"))
    names = ("direction", "magnitude", "surprise", "credibility")
    composite = F.col("direction") * F.col("magnitude") * F.col("surprise") * F.col("credibility")
    ok = F.col("error_message").isNull()
    df = df.withColumns({n: F.when(ok, F.col(n)) for n in names})
    return df.withColumns(
        {
            "composite_score": F.when(ok, composite),
            "score_version": F.lit(VERSION),
            "scoring_detail": F.when(ok, F.to_json(F.struct(*names, "amount"))),
            "processing_status": F.when(ok, "scored").otherwise("failed"),
        }
    )
