"""Registered queries: the rule engine, extraction, classifier metrics, upserts, labelling, reports."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, extraction, labelling, report, scoring, stats, upsert
from . import stages
from . import taxonomy as T
from .bridge import Tables
from .catalog_queries import _ITEM_VIEWS, _ITEMS, _items
from .catalog_scalars import _LABELLED, _WALK, _labelled
from .registry import query


def _field(name: str) -> str:
    return (
        f"max(CASE WHEN field_name = '{name}' THEN v END) AS {name}, coalesce(bool_or(field_name = '{name}' AND CASE WHEN field_type = 'numeric' THEN v IS NOT NULL ELSE field_value IS NOT NULL END), false) AS {name}_p, "
        f"coalesce(bool_or(field_name = '{name}' AND field_type <> 'numeric' AND field_value IS NOT NULL AND v IS NULL), false) AS {name}_bad, "
        f"coalesce(bool_or(field_name = '{name}' AND CASE WHEN field_type = 'numeric' THEN coalesce(v <> 0, false) ELSE coalesce(field_value <> '', false) END), false) AS {name}_t"
    )


_NAMES = (
    "net_profit_yoy_pct", "revenue_yoy_pct", "revision_pct", "increase_ratio_pct", "decrease_ratio_pct", "forecast_net_profit_max", *T.AMOUNT_FIELDS,
)
_RISK = ", ".join(f"'{s}'" for s in T.RISK_SUBS)
_CLAMP = "least({2}::DOUBLE, greatest({1}::DOUBLE, {0}))"


def _clamp(v: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"CASE WHEN ({v}) IS NOT NULL THEN {_CLAMP.format(f'({v})', low, high)} END"


_SCORE = f"""
, wide AS (SELECT announcement_id, {', '.join(_field(n) for n in _NAMES)} FROM last_fields GROUP BY announcement_id),
joined AS (SELECT a.id AS announcement_id, c.major_category, c.sub_category, e.direction_baseline AS base, co.id AS co, co.annual_revenue, co.net_assets, w.* EXCLUDE (announcement_id),
  coalesce({', '.join('w.' + n for n in T.AMOUNT_FIELDS)}) AS amount, e.fields AS expected,
  CASE WHEN coalesce(w.involved_amount_t, false) THEN w.involved_amount WHEN coalesce(w.default_amount_t, false) THEN w.default_amount ELSE w.penalty_amount END AS loss,
  CASE WHEN coalesce(w.involved_amount_t, false) THEN w.involved_amount_bad WHEN coalesce(w.default_amount_t, false) THEN w.default_amount_bad ELSE w.penalty_amount_bad END AS loss_bad,
  coalesce(w.involved_amount_t OR w.default_amount_t OR w.penalty_amount_p, false) AS has_loss,
  (SELECT count(*) FROM last_fields l WHERE l.announcement_id = a.id AND list_contains(e.fields, l.field_name) AND CASE WHEN l.field_type = 'numeric' THEN l.v IS NOT NULL ELSE l.field_value IS NOT NULL END) AS filled
  FROM announcements a LEFT JOIN classifications c ON c.announcement_id = a.id LEFT JOIN events_dim e ON e.sub = c.sub_category LEFT JOIN companies co ON co.id = a.company_id LEFT JOIN wide w ON w.announcement_id = a.id),
dims AS (SELECT *, coalesce(nullif(annual_revenue, 0), nullif(net_assets, 0), 1)::DOUBLE AS size FROM joined),
raw AS (SELECT announcement_id, major_category, sub_category, amount,
  CASE WHEN base IS NULL THEN 0.0::DOUBLE ELSE {_clamp(f'''CASE WHEN starts_with(sub_category, 'earnings_') AND net_profit_yoy_pct_p THEN {_clamp('net_profit_yoy_pct / 50.0::DOUBLE', -1.0)}
    WHEN starts_with(sub_category, 'earnings_') AND revenue_yoy_pct_p THEN {_clamp('revenue_yoy_pct / 30.0::DOUBLE', -1.0)}
    WHEN sub_category = 'forecast_revision' AND revision_pct_p THEN {_clamp('revision_pct / 20.0::DOUBLE', -1.0)}
    WHEN sub_category = 'equity_increase' AND increase_ratio_pct_p THEN {_clamp('increase_ratio_pct / 5.0::DOUBLE')}
    WHEN sub_category = 'equity_decrease' AND decrease_ratio_pct_p THEN {_clamp('-decrease_ratio_pct / 5.0::DOUBLE', -1.0, 0.0)}
    WHEN sub_category = 'major_contract' AND contract_amount_p THEN {_clamp('contract_amount / 100000.0::DOUBLE')}
    WHEN sub_category IN ({_RISK}) AND has_loss THEN {_clamp('-loss / 50000.0::DOUBLE', -1.0, 0.0)} ELSE base END''', -1.0)} END AS direction,
  CASE WHEN base IS NULL THEN false WHEN starts_with(sub_category, 'earnings_') AND net_profit_yoy_pct_p THEN net_profit_yoy_pct_bad WHEN starts_with(sub_category, 'earnings_') AND revenue_yoy_pct_p THEN revenue_yoy_pct_bad
    WHEN sub_category = 'forecast_revision' AND revision_pct_p THEN revision_pct_bad WHEN sub_category = 'equity_increase' AND increase_ratio_pct_p THEN increase_ratio_pct_bad
    WHEN sub_category = 'equity_decrease' AND decrease_ratio_pct_p THEN decrease_ratio_pct_bad WHEN sub_category = 'major_contract' AND contract_amount_p THEN contract_amount_bad
    WHEN sub_category IN ({_RISK}) AND has_loss THEN loss_bad ELSE false END AS d_bad,
  amount IS NOT NULL AND co IS NOT NULL AS counted, 1.0::DOUBLE + CASE WHEN abs(size) < 1e-10 THEN 0.0::DOUBLE ELSE abs(amount) / size END * 10.0::DOUBLE AS inside, base, expected, filled,
  CASE WHEN sub_category = 'forecast_revision' AND revision_pct_p THEN {_clamp('abs(revision_pct) / 50.0::DOUBLE')}
    WHEN starts_with(sub_category, 'earnings_') AND forecast_net_profit_max_p AND net_profit_p THEN {_clamp('CASE WHEN abs(forecast_net_profit_max) < 1e-10 THEN 0.0::DOUBLE ELSE abs(net_profit - forecast_net_profit_max) / abs(forecast_net_profit_max) END')} ELSE 0.5::DOUBLE END AS surprise,
  CASE WHEN sub_category = 'forecast_revision' AND revision_pct_p THEN revision_pct_bad WHEN starts_with(sub_category, 'earnings_') AND forecast_net_profit_max_p AND net_profit_p THEN forecast_net_profit_max_bad OR net_profit_bad ELSE false END AS s_bad FROM dims),
scored AS (SELECT announcement_id, major_category, sub_category, amount, direction, surprise,
  CASE WHEN counted THEN {_clamp('CASE WHEN inside > 0 THEN log10(inside) END')} ELSE coalesce(abs(base), 0.5::DOUBLE) END AS magnitude,
  {_clamp('0.9::DOUBLE * CASE WHEN len(expected) > 0 THEN filled / len(expected)::DOUBLE ELSE 0.5::DOUBLE END')} AS credibility,
  CASE WHEN sub_category IS NULL THEN 'Missing classification' WHEN d_bad THEN 'direction: not a number' WHEN coalesce(counted AND inside <= 0, false) THEN 'magnitude: outside the logarithm' WHEN s_bad THEN 'surprise: not a number' END AS error_message FROM raw)
"""
_SCORE_VIEWS = ("announcements", "classifications", "events_dim", "companies", "last_fields")


def _scored(t: Tables) -> DataFrame:
    return scoring.score(t.announcements, t.classifications, t.companies, t.field_map)


def _rule(name: str, columns: str, spark_columns) -> None:
    query(name, f"WITH one AS (SELECT 1){_SCORE} SELECT announcement_id, {columns} FROM scored", *_SCORE_VIEWS)(lambda t: _scored(t).select("announcement_id", *spark_columns()))


def _ok(value: str, name: str) -> str:
    return f"CASE WHEN error_message IS NULL THEN round({value}, 8) + 0.0::DOUBLE END AS {name}"


_r = lambda c: (F.round(c, 8) + 0.0).alias(c)
for _name, _column, _value in (
    ("rul01_direction", "direction", "direction"), ("rul10_magnitude", "magnitude", "magnitude"), ("rul12_surprise", "surprise", "surprise"),
    ("rul15_credibility", "credibility", "credibility"), ("rul16_composite", "composite_score", "direction * magnitude * surprise * credibility"),
):
    _rule(_name, _ok(_value, _column), lambda c=_column: [_r(c)])
_rule("rul09_amount", "amount", lambda: ["amount"])
_rule("rul17_failures", "error_message, CASE WHEN error_message IS NULL THEN 'scored' ELSE 'failed' END AS processing_status", lambda: ["error_message", "processing_status"])


@query("rul18_industry_of", "SELECT announcement_id, industry, industry_group FROM classifications", "classifications")
def _(t: Tables) -> DataFrame:
    return t.classifications.select("announcement_id", "industry", "industry_group")


_JSON = """'{"revenue": ' || (event_id % 100) || ', "eps": ' || CASE event_id % 3 WHEN 0 THEN '1.5' WHEN 1 THEN 'null' ELSE 'true' END || ', "summary": "s' || event_id || '", "key_entities": [1, 2], "other": 1}'"""


def _results(t: Tables) -> DataFrame:
    k = F.col("event_id")
    eps = F.when(k % 3 == 0, "1.5").when(k % 3 == 1, "null").otherwise("true")
    js = F.concat(F.lit('{"revenue": '), (k % 100).cast("string"), F.lit(', "eps": '), eps, F.lit(', "summary": "s'), k.cast("string"), F.lit('", "key_entities": [1, 2], "other": 1}'))
    bad = F.when(k % 11 == 0, "no json").otherwise(js)
    return t.raw("events").select(k.alias("announcement_id"), F.when(k % 2 == 0, "earnings_q1").otherwise("unheard_of").alias("sub_category"), bad.alias("result"))


@query(
    "ext03_typed_fields",
    """WITH k AS (SELECT event_id AS id FROM events WHERE event_id % 11 <> 0)
    SELECT id AS announcement_id, 'revenue' AS field_name, (id % 100)::VARCHAR AS field_value, 'numeric' AS field_type FROM k
    UNION ALL SELECT id, 'eps', CASE id % 3 WHEN 0 THEN '1.5' WHEN 2 THEN 'True' END, CASE id % 3 WHEN 1 THEN 'text' ELSE 'numeric' END FROM k
    UNION ALL SELECT id, 'summary', 's' || id, 'text' FROM k UNION ALL SELECT id, 'key_entities', '[1,2]', 'json' FROM k UNION ALL SELECT id, 'other', '1', 'numeric' FROM k WHERE id % 2 = 1""",
)
def _(t: Tables) -> DataFrame:
    return extraction.to_fields(_results(t)).select("announcement_id", "field_name", "field_value", "field_type")


@query("ext02_kept_fields", "SELECT event_id AS announcement_id, CASE WHEN event_id % 2 = 0 THEN 4 ELSE 5 END::BIGINT AS n FROM events WHERE event_id % 11 <> 0")
def _(t: Tables) -> DataFrame:
    return extraction.to_fields(_results(t)).groupBy("announcement_id").agg(F.count("*").alias("n"))


@query(
    "ext01_prompts",
    """SELECT a.id, CASE WHEN e.sub IS NOT NULL THEN 'Event: ' || e.sub_label || chr(10) || 'Fields: ' || array_to_string(e.fields, ', ') ELSE 'Event: unknown' || chr(10) || 'Fields: event_type, direction, summary, key_entities, amount, ratio' END
    || chr(10) || 'Title: ' || a.title || chr(10) || 'Text: ' || coalesce(a.full_text, '(no text)') AS prompt FROM announcements a LEFT JOIN classifications c ON c.announcement_id = a.id LEFT JOIN events_dim e ON e.sub = c.sub_category""",
    "announcements", "classifications", "events_dim",
)
def _(t: Tables) -> DataFrame:
    ev = F.broadcast(T.events_df(t.spark).select(F.col("sub").alias("sub_category"), "sub_label", "fields"))
    df = t.announcements.join(t.classifications.select(F.col("announcement_id").alias("id"), "sub_category"), "id", "left").join(ev, "sub_category", "left")
    return df.select("id", extraction.prompt(F.col("title"), F.col("full_text"), F.col("sub_label"), F.col("fields")).alias("prompt"))


@query(
    "ext05_replace_fields",
    "SELECT announcement_id, count(*) AS n FROM eav WHERE announcement_id % 4 <> 0 GROUP BY ALL UNION ALL SELECT announcement_id, 1 FROM eav WHERE announcement_id % 4 = 0 GROUP BY ALL",
    "eav",
)
def _(t: Tables) -> DataFrame:
    old = t.fields.select("announcement_id", "field_name", "field_value")
    new = old.where("announcement_id % 4 = 0").groupBy("announcement_id").agg(F.min("field_name").alias("field_name")).withColumn("field_value", F.lit("new"))
    return upsert.replace_all(old, new, "announcement_id").groupBy("announcement_id").agg(F.count("*").alias("n"))


def _logits(t: Tables) -> DataFrame:
    return t.raw("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10.0).alias("logits"), (F.col("label") % 10).alias("label"))


_L = "(SELECT vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE * 10.0::DOUBLE) AS logits, label % 10 AS label FROM embeddings)"
_CONF = "1.0::DOUBLE / list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / {0})))"


@query("ml02_softmax", f"SELECT vec_id, list_position(logits, list_max(logits)) - 1 AS predicted, round({_CONF.format('1.0::DOUBLE')}, 6) AS confidence FROM {_L}")
def _(t: Tables) -> DataFrame:
    p = calibration.softmax(F.col("logits"))
    return _logits(t).select("vec_id", calibration.argmax(F.col("logits")).cast("int").alias("predicted"), F.round(F.array_max(p), 6).alias("confidence"))


@query("ml02_with_temperature", f"SELECT vec_id, round({_CONF.format('0.35::DOUBLE')}, 6) AS confidence FROM {_L}")
def _(t: Tables) -> DataFrame:
    return _logits(t).select("vec_id", F.round(calibration.confidence(F.col("logits"), calibration.valid_temperature(0.35)), 6).alias("confidence"))


@query("ord08_top_classes", f"SELECT vec_id, i - 1 AS i, place FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY logits[i] DESC, i) - 1 AS place FROM (SELECT vec_id, logits, unnest(range(1, 11)) AS i FROM {_L})) WHERE place < 3")
def _(t: Tables) -> DataFrame:
    top = calibration.top_k(calibration.softmax(F.col("logits")))
    return _logits(t).select("vec_id", F.posexplode(top).alias("place", "s")).select("vec_id", F.col("s.i").cast("long").alias("i"), F.col("place").cast("long").alias("place"))


@query("ord09_argmax", f"SELECT vec_id, list_position(logits, list_max(logits)) - 1 AS predicted FROM {_L}")
def _(t: Tables) -> DataFrame:
    return _logits(t).select("vec_id", calibration.argmax(F.col("logits")).cast("int").alias("predicted"))


@query("ml04_label_names", "SELECT vec_id, coalesce(e.major, '?') AS major FROM embeddings LEFT JOIN events_dim e ON e.sub = CASE WHEN label % 2 = 0 THEN 'buyback' ELSE 'unknown_' || label END", "events_dim")
def _(t: Tables) -> DataFrame:
    sub = F.when(F.col("label") % 2 == 0, "buyback").otherwise(F.concat(F.lit("unknown_"), F.col("label").cast("string")))
    ev = F.broadcast(T.events_df(t.spark).select(F.col("sub").alias("s"), "major"))
    return t.raw("embeddings").select("vec_id", sub.alias("s")).join(ev, "s", "left").select("vec_id", F.coalesce("major", F.lit("?")).alias("major"))


@query(
    "ml07_split_sizes",
    """SELECT sub_category, split, count(*) AS n FROM (SELECT p_brand AS sub_category, CASE WHEN (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / (count(*) OVER (PARTITION BY p_brand))::DOUBLE < 0.7::DOUBLE THEN 'train'
    WHEN (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / (count(*) OVER (PARTITION BY p_brand))::DOUBLE < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM part) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = t.raw("part").select(F.col("p_brand").alias("sub_category"), "p_partkey")
    return labelling.split(rows, "p_partkey").groupBy("sub_category", "split").agg(F.count("*").alias("n"))


_TP = "(SELECT quality AS t, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE toxic END AS p FROM labels)"


def _predicted(t: Tables) -> DataFrame:
    return t.raw("labels").select(F.col("quality").alias("truth"), F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("toxic")).alias("predicted"))


_CLASSES = f"""cells AS (SELECT t, p, count(*) AS n FROM {_TP} GROUP BY ALL), names AS (SELECT t AS label FROM cells UNION SELECT p FROM cells),
per AS (SELECT label, coalesce(sum(n) FILTER (t = label AND p = label), 0) AS hits, coalesce(sum(n) FILTER (t = label), 0) AS support, coalesce(sum(n) FILTER (p = label), 0) AS predicted FROM names, cells GROUP BY label),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS pp, CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS rr FROM per),
f AS (SELECT label, support::BIGINT AS support, hits, pp AS precision, rr AS recall, CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END AS f1 FROM pr)"""


@query("ml09_averages", f"WITH {_CLASSES} SELECT round(sum(hits) / sum(support)::DOUBLE, 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM f")
def _(t: Tables) -> DataFrame:
    a = calibration.averages(calibration.class_report(_predicted(t)))
    return a.select(*[F.round(c, 9).alias(c) for c in a.columns])


@query("ml10_class_report", f"WITH {_CLASSES} SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def _(t: Tables) -> DataFrame:
    return calibration.class_report(_predicted(t)).select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("ml10_confusion", f"SELECT a.v AS truth, b.v AS predicted, (SELECT count(*) FROM {_TP} WHERE t = a.v AND p = b.v) AS n FROM (SELECT t AS v FROM {_TP} UNION SELECT p FROM {_TP}) a, (SELECT t AS v FROM {_TP} UNION SELECT p FROM {_TP}) b")
def _(t: Tables) -> DataFrame:
    return calibration.confusion(_predicted(t))


_EDGES = " + ".join(f"(confidence >= {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))


def _ece_sql(t: str) -> str:
    return f"SELECT sum(n * abs(acc - conf)) / sum(n) AS ece FROM (SELECT {_EDGES} AS bin, count(*) AS n, avg(correct::INT) AS acc, avg(confidence) AS conf FROM (SELECT {_CONF.format(t)} AS confidence, list_position(logits, list_max(logits)) - 1 = label AS correct FROM {_L}) GROUP BY bin)"


@query("ml11_calibration_error", f"SELECT round(ece, 6) AS ece FROM ({_ece_sql('1.0::DOUBLE')})")
def _(t: Tables) -> DataFrame:
    rows = _logits(t).select((calibration.argmax(F.col("logits")) == F.col("label")).alias("correct"), calibration.confidence(F.col("logits")).alias("confidence"))
    return calibration.ece(rows).select(F.round("ece", 6).alias("ece"))


@query("ml12_temperature_search", " UNION ALL ".join(f"SELECT round({t!r}::DOUBLE, 2) AS temperature, round(ece, 6) AS ece FROM ({_ece_sql(f'{t!r}::DOUBLE')})" for t in calibration.TEMPERATURES))
def _(t: Tables) -> DataFrame:
    return calibration.temperature_search(_logits(t)).select(F.round("temperature", 2).alias("temperature"), F.round("ece", 6).alias("ece"))


@query(
    "ml13_diagnostics",
    f"""SELECT round(avg(c), 6) AS mean, round(coalesce(avg(c) FILTER (ok), 0), 6) AS mean_right, round(coalesce(avg(c) FILTER (NOT ok), 0), 6) AS mean_wrong, count(*) FILTER (ok) AS hits, round(min(c), 6) AS least, round(max(c), 6) AS most
    FROM (SELECT {_CONF.format('1.0::DOUBLE')} AS c, list_position(logits, list_max(logits)) - 1 = label AS ok FROM {_L})""",
)
def _(t: Tables) -> DataFrame:
    rows = _logits(t).select((calibration.argmax(F.col("logits")) == F.col("label")).alias("correct"), calibration.confidence(F.col("logits")).alias("confidence"))
    d = calibration.diagnostics(rows)
    return d.select(*[F.round(c, 6).alias(c) if c != "hits" else F.col(c) for c in d.columns])


_FILLERS = {"co": ["甲公司", "乙公司", "丙公司"], "n": (200, 50_000), "n2": (1, 9), "pct": ["5%", "80%"]}


def _draw(n: str, *what: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '42', sub_category, i::VARCHAR{''.join(f", '{w}'" for w in what)})), 1, 8))::BIGINT % {n})"


def _fill_sql(part: str) -> str:
    text = f"t.{part}"
    for name in sorted(_FILLERS, key=lambda n: (-len(n), n)):
        values = _FILLERS[name]
        value = f"({_draw(str(values[1] - values[0] + 1), part, name)} + {values[0]})::VARCHAR" if isinstance(values, tuple) else f"{values}[{_draw(str(len(values)), part, name)}::INT + 1]"
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


@query(
    "ml14_seed_rows",
    f"""WITH one AS (SELECT 1), templates AS (SELECT [{", ".join(f"'{e.sub}'" for e in T.events())}][p_partkey % {len(T.events())} + 1] AS sub_category, p_name || ' {{co}}: {{n}} of {{n2}}' AS title, 'up {{pct}} ({{n}}), {{co}} ' || p_brand AS body FROM part),
    by_sub AS (SELECT sub_category, list_sort(list(DISTINCT {{'title': title, 'body': body}})) AS ts FROM templates GROUP BY sub_category),
    drawn AS (SELECT sub_category, i, ts[{_draw("len(ts)", "template")}::INT + 1] AS t FROM by_sub, range(32) r(i))
    SELECT sub_category, i::INT AS i, {_fill_sql("title")} || chr(10) || {_fill_sql("body")} AS text FROM drawn""",
)
def _(t: Tables) -> DataFrame:
    """Templates are the rows of `part`; 32 filled rows a sub-category."""
    sub = F.get(F.array(*[F.lit(e.sub) for e in T.events()]), (F.col("p_partkey") % len(T.events())).cast("int"))
    templates = t.raw("part").select(sub.alias("sub_category"), F.concat("p_name", F.lit(" {co}: {n} of {n2}")).alias("title"), F.concat(F.lit("up {pct} ({n}), {co} "), "p_brand").alias("body"))
    return labelling.seed_rows(templates, _FILLERS)


def _fresh_companies(t: Tables) -> DataFrame:
    return t.companies.where("id % 2 = 0").select("stock_code", F.concat(F.lit("new "), "stock_name").alias("stock_name"), F.when(F.col("id") % 4 == 0, "银行").alias("industry")).unionByName(
        t.companies.where("id % 5 = 0").select(F.concat(F.lit("N"), "stock_code").alias("stock_code"), "stock_name", F.lit("证券").alias("industry"))
    )


@query(
    "ups01_company_upsert",
    """SELECT stock_code, CASE WHEN id % 2 = 0 THEN 'new ' || stock_name ELSE stock_name END AS stock_name, CASE WHEN id % 4 = 0 THEN '银行' ELSE industry END AS industry FROM companies
    UNION ALL SELECT 'N' || stock_code, stock_name, '证券' FROM companies WHERE id % 5 = 0""",
    "companies",
)
def _(t: Tables) -> DataFrame:
    return upsert.merge_non_null(t.companies.select("stock_code", "stock_name", "industry"), _fresh_companies(t), ["stock_code"])


def _fresh_announcements(t: Tables) -> DataFrame:
    a = t.announcements.select("announcement_id", "title", "full_text", "processing_status")
    old = a.where("announcement_id like '%1'").select("announcement_id", F.lit("changed").alias("title"), F.lit(None).cast("string").alias("full_text"), F.lit("fetched").alias("processing_status"))
    new = a.where("announcement_id like '%7'").select(F.concat("announcement_id", F.lit("-B")).alias("announcement_id"), "title", "full_text", F.lit("fetched").alias("processing_status"))
    return old.unionByName(new)


@query(
    "ups02_bulk_upsert",
    """SELECT announcement_id, CASE WHEN announcement_id LIKE '%1' THEN 'changed' ELSE title END AS title, full_text, processing_status FROM announcements
    UNION ALL SELECT announcement_id || '-B', title, full_text, 'fetched' FROM announcements WHERE announcement_id LIKE '%7'""",
    "announcements",
)
def _(t: Tables) -> DataFrame:
    a = t.announcements.select("announcement_id", "title", "full_text", "processing_status")
    return upsert.merge_non_null(a, _fresh_announcements(t), ["announcement_id"], keep=("processing_status",))


@query("ups02_inserted_count", "SELECT count(*) AS n FROM announcements WHERE announcement_id LIKE '%7'", "announcements")
def _(t: Tables) -> DataFrame:
    return upsert.inserted(t.announcements, _fresh_announcements(t), ["announcement_id"]).agg(F.count("*").alias("n"))


@query("ups03_set_status", "SELECT id, CASE WHEN id % 6 = 0 THEN 'preprocessed' ELSE processing_status END AS processing_status, CASE WHEN id % 6 <> 0 THEN error_message END AS error_message FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    changes = t.announcements.where("id % 6 = 0").select("id", F.lit("preprocessed").alias("status"), F.lit(None).cast("string").alias("error"))
    return upsert.set_status(t.announcements, changes).select("id", "processing_status", "error_message")


@query(
    "ups04_replace_rows",
    "SELECT announcement_id, CASE WHEN announcement_id % 8 = 0 THEN 'buyback' ELSE sub_category END AS sub_category, CASE WHEN announcement_id % 8 <> 0 THEN industry END AS industry FROM classifications",
    "classifications",
)
def _(t: Tables) -> DataFrame:
    old = t.classifications.select("announcement_id", "sub_category", "industry")
    new = old.where("announcement_id % 8 = 0").select("announcement_id", F.lit("buyback").alias("sub_category"), F.lit(None).cast("string").alias("industry"))
    return upsert.replace(old, new, ["announcement_id"])


@query(
    "ups06_null_safe_upsert",
    """SELECT o_orderdate::DATE AS report_date, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS industry_filter, max(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS fresh FROM orders GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    key = [F.to_date("o_orderdate").alias("report_date"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("industry_filter")]
    side = lambda odd: t.raw("orders").where(F.col("o_orderkey") % 2 == odd).select(*key).distinct().withColumn("fresh", F.lit(1 - odd))
    return upsert.merge_non_null(side(1), side(0), ["report_date", "industry_filter"])


@query("ups09_added_column", "SELECT id, NULL::VARCHAR AS pdf_url FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    more = {"pdf_url": "string"}
    return upsert.ensure_columns(upsert.ensure_columns(t.announcements, more), more).select("id", "pdf_url")


@query("ups10_preprocess_stage", "SELECT id, CASE WHEN processing_status = 'fetched' THEN 'preprocessed' ELSE processing_status END AS processing_status, CASE WHEN processing_status = 'fetched' THEN coalesce(full_text, title) ELSE full_text END AS full_text FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return stages.preprocess(t.announcements).select("id", "processing_status", "full_text")


@query(
    "ups10_score_stage",
    f"""WITH one AS (SELECT 1){_SCORE} SELECT a.id, CASE WHEN a.processing_status = 'extracted' THEN CASE WHEN s.error_message IS NULL THEN 'scored' ELSE 'failed' END ELSE a.processing_status END AS processing_status
    FROM announcements a JOIN scored s ON s.announcement_id = a.id""",
    *_SCORE_VIEWS,
)
def _(t: Tables) -> DataFrame:
    after, _ = stages.score(t.announcements, t.classifications, t.companies, t.field_map)
    return after.select("id", "processing_status")


@query(
    "lab01_export",
    """SELECT announcement_id, substr(title || chr(10) || coalesce(full_text, ''), 1, 3000) AS text FROM (SELECT * FROM announcements ORDER BY full_text IS NULL, published_date DESC, id LIMIT 200)
    WHERE announcement_id NOT IN (SELECT announcement_id FROM announcements WHERE id % 3 = 0)""",
    "announcements",
)
def _(t: Tables) -> DataFrame:
    return labelling.export_unlabelled(t.announcements, t.announcements.where("id % 3 = 0")).select("announcement_id", "text")


@query("lab02_validate", f"SELECT count(*) FILTER (sub_category <> '' AND text <> '') AS valid, count(*) FILTER (sub_category = '' OR text = '') AS invalid FROM {_LABELLED}")
def _(t: Tables) -> DataFrame:
    return labelling.valid(_labelled(t))


# the second set repeats rows of the first, so none of its rows is kept
@query(
    "lab03_merge_counts",
    f"""{_WALK}, all_ AS (SELECT * FROM {_LABELLED} UNION ALL SELECT * FROM {_LABELLED} WHERE place % 2 = 0),
    n AS (SELECT count(*) AS total, count(*) FILTER (sub_category <> '' AND text <> '') AS labelled, count(*) FILTER (text <> '' AND sub_category IN (SELECT sub FROM events_dim)) AS known,
      (SELECT count(*) FROM walk WHERE kept) AS kept FROM all_)
    SELECT kept AS merged, total - labelled + known - kept AS skipped, labelled - known AS invalid FROM n""",
    "events_dim",
)
def _(t: Tables) -> DataFrame:
    _, counts = labelling.merge([_labelled(t), _labelled(t).where("place % 2 = 0")])
    return t.spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


@query(
    "rpt02_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (abs(composite_score) >= 0.5::DOUBLE) AS high,
    CASE WHEN count(*) FILTER (abs(composite_score) >= 0.5::DOUBLE) = 0 THEN '1996-06-30 共处理 ' || count(*) || ' 条公告，无高影响事件。'
      ELSE '1996-06-30 共处理 ' || count(*) || ' 条公告，其中 ' || count(*) FILTER (abs(composite_score) >= 0.5::DOUBLE) || ' 条高影响事件。 最高评分: '
        || (SELECT substr(title, 1, 30) || '... (综合: ' || format('{{:+.3f}}', composite_score) FROM {_ITEMS} ORDER BY abs(composite_score) DESC, announcement_id LIMIT 1) || ')' END AS summary_text FROM {_ITEMS}""",
    *_ITEM_VIEWS,
)
def _(t: Tables) -> DataFrame:
    return report.summary(_items(t), "1996-06-30").select("total", "high", "summary_text")


_GROUP_LIST = ", ".join(f"'{i}': '{g}'" for i, g in T.industries())


@query(
    "rpt01_markdown",
    f"""WITH one AS (SELECT 1), its AS (SELECT *, coalesce(nullif(industry_group, ''), (MAP {{{_GROUP_LIST}}})[industry], '{T.DEFAULT_GROUP}') AS grp FROM {_ITEMS}),
    strong AS (SELECT *, row_number() OVER (ORDER BY abs(composite_score) DESC, announcement_id) AS place FROM its WHERE abs(composite_score) >= 0.5::DOUBLE),
    head AS (SELECT '# 公告事件驱动分析日报' || chr(10) || '**日期**: 1996-06-30' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 一、执行摘要' || chr(10) || chr(10) || '- **公告总数**: ' || count(*) || chr(10)
      || '- **高影响事件**: ' || count(*) FILTER (abs(composite_score) >= 0.5::DOUBLE) || ' (阈值 |score| ≥ 0.5)' || chr(10) || '- **利好信号**: ' || count(*) FILTER (composite_score > 0.1::DOUBLE)
      || ' | **利空信号**: ' || count(*) FILTER (composite_score < -0.1::DOUBLE) || ' | **中性**: ' || count(*) - count(*) FILTER (composite_score > 0.1::DOUBLE) - count(*) FILTER (composite_score < -0.1::DOUBLE) || chr(10) AS x FROM its),
    rows_ AS (SELECT string_agg('| ' || coalesce(stock_name, '?') || '(' || coalesce(stock_code, '?') || ') | ' || coalesce(nullif(industry, ''), '?') || ' | ' || substr(coalesce(title, ''), 1, 30) || ' | ' || coalesce(sub_category, '?')
      || format(' | {{:+.2f}} | {{:.2f}} | {{:.2f}} | {{:.2f}} | **{{:+.3f}}** |', direction, magnitude, surprise, credibility, composite_score), chr(10) ORDER BY place) AS x FROM strong WHERE place <= 20),
    cats AS (SELECT string_agg('- **' || k || '**: ' || n || ' 条', chr(10) ORDER BY n DESC, k) AS x FROM (SELECT concat_ws('-', major_category, sub_category) AS k, count(*) AS n FROM its WHERE sub_category IS NOT NULL GROUP BY k)),
    groups AS (SELECT string_agg('- **' || grp || '**: ' || n || ' 条', chr(10) ORDER BY n DESC, grp) AS x FROM (SELECT grp, count(*) AS n FROM its GROUP BY grp)),
    deep AS (SELECT string_agg('### ' || place || '. ' || coalesce(stock_name, '?') || ' — ' || coalesce(title, '(无标题)') || chr(10) || chr(10) || '- **综合评分**: ' || format('{{:+.3f}}', composite_score) || chr(10) || chr(10)
      || '> *(AI 分析暂不可用)*' || chr(10), chr(10) ORDER BY place) AS x FROM strong WHERE place <= 10)
    SELECT head.x || chr(10) || '## 二、高影响事件' || chr(10) || chr(10)
      || coalesce('| 股票 | 行业 | 公告标题 | 分类 | 方向 | 强度 | 意外度 | 可信度 | 综合评分 |' || chr(10) || '|------|------|---------|------|------|------|--------|--------|----------|' || chr(10) || rows_.x, '*今日无高影响事件*') || chr(10) || chr(10)
      || '## 三、分类分布' || chr(10) || chr(10) || coalesce(cats.x, '') || chr(10) || chr(10) || '## 四、行业分布' || chr(10) || chr(10) || coalesce(groups.x, '') || chr(10) || chr(10) || coalesce('## 五、深度分析' || chr(10) || chr(10) || deep.x, '') AS text
    FROM head, rows_, cats, groups, deep""",
    *_ITEM_VIEWS,
)
def _(t: Tables) -> DataFrame:
    return report.markdown(_items(t), "1996-06-30")


@query("rpt03_reported", "SELECT id, CASE WHEN processing_status = 'scored' AND published_date <= DATE '1995-12-31' AND id IN (SELECT announcement_id FROM scores) THEN 'reported' ELSE processing_status END AS processing_status FROM announcements", "announcements", "scores")
def _(t: Tables) -> DataFrame:
    due = t.announcements.where((F.col("processing_status") == "scored") & (F.col("published_date") <= F.lit("1995-12-31").cast("date")))
    return stages.mark_reported(t.announcements, report.items(due, t.scores, t.classifications, t.companies)).select("id", "processing_status")


@query("rpt04_dashboard_charts", "SELECT 'category' AS chart, major_category AS name, count(*) AS n FROM classifications GROUP BY ALL UNION ALL SELECT 'industry', industry_group, count(*) FROM classifications GROUP BY ALL", "classifications")
def _(t: Tables) -> DataFrame:
    a = t.announcements.select(F.col("announcement_id").alias("run_id"), F.col("published_date").alias("started_at"), F.col("published_date").alias("report_date"), "id")
    d = stats.dashboard(t.announcements, t.classifications, t.scores, a, a)
    parts = [d[k].select(F.lit(k).alias("chart"), F.col(c).alias("name"), "n") for k, c in (("category", "major_category"), ("industry", "industry_group"))]
    return functools.reduce(DataFrame.unionByName, parts)


@query("ups05_score_replace", "SELECT announcement_id, CASE WHEN announcement_id % 9 = 0 THEN 0.0::DOUBLE ELSE composite_score END AS composite_score, CASE WHEN announcement_id % 9 <> 0 THEN direction END AS market_reaction FROM scores", "scores")
def _(t: Tables) -> DataFrame:
    old = t.scores.select("announcement_id", "composite_score", F.col("direction").alias("market_reaction"))
    new = old.where("announcement_id % 9 = 0").select("announcement_id", F.lit(0.0).alias("composite_score"))
    return upsert.replace(old, new, ["announcement_id"])


@query("ups08_seed_upsert", "SELECT stock_code, coalesce(industry, '') AS industry, id % 4 = 0 AS is_tracked FROM companies", "companies")
def _(t: Tables) -> DataFrame:
    old = t.companies.select("stock_code", "industry", "is_tracked")
    new = t.companies.select("stock_code", F.coalesce("industry", F.lit("")).alias("industry"), (F.col("id") % 4 == 0).alias("is_tracked"))
    return upsert.merge_non_null(old, new, ["stock_code"])


@query("ext04_constants", "SELECT 0.8::DOUBLE AS confidence, 'model' AS model_used, count(*) FILTER (event_id % 11 <> 0) * 4 + count(*) FILTER (event_id % 11 <> 0 AND event_id % 2 = 1) AS n FROM events")
def _(t: Tables) -> DataFrame:
    return extraction.to_fields(_results(t)).groupBy("confidence", "model_used").agg(F.count("*").alias("n"))


@query("jn05_scoring_inputs", "SELECT a.id, c.sub_category, co.annual_revenue, (SELECT count(*) FROM last_fields l WHERE l.announcement_id = a.id) AS n FROM announcements a LEFT JOIN classifications c ON c.announcement_id = a.id LEFT JOIN companies co ON co.id = a.company_id", "announcements", "classifications", "companies", "last_fields")
def _(t: Tables) -> DataFrame:
    c = t.classifications.select(F.col("announcement_id").alias("id"), "sub_category")
    co = t.companies.select(F.col("id").alias("company_id"), "annual_revenue")
    f = t.field_map.select(F.col("announcement_id").alias("id"), F.size("fields").alias("n"))
    df = t.announcements.select("id", "company_id").join(c, "id", "left").join(co, "company_id", "left").join(f, "id", "left")
    return df.select("id", "sub_category", "annual_revenue", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("ord03_report_order", f"SELECT announcement_id, place FROM (SELECT announcement_id, row_number() OVER (ORDER BY abs(composite_score) DESC, announcement_id)::INT AS place FROM {_ITEMS} WHERE abs(composite_score) >= 0.5::DOUBLE) WHERE place <= 10", *_ITEM_VIEWS)
def _(t: Tables) -> DataFrame:
    return report.ranked(_items(t).where(F.abs("composite_score") >= T.HIGH_IMPACT), T.TOP_N).select("announcement_id", "place")


@query("rpt05_detail_page", "SELECT a.id, a.title, co.stock_name, c.sub_category, s.composite_score FROM announcements a LEFT JOIN companies co ON co.id = a.company_id LEFT JOIN classifications c ON c.announcement_id = a.id LEFT JOIN scores s ON s.announcement_id = a.id WHERE a.id = 42", "announcements", "companies", "classifications", "scores")
def _(t: Tables) -> DataFrame:
    from ..operators import search

    one = t.announcements.where("id = 42")
    return search.details(one, t.companies, t.classifications.where("announcement_id = 42"), t.scores.where("announcement_id = 42")).select("id", "title", "stock_name", "sub_category", "composite_score")


@query(
    "ups07_run_rows",
    """SELECT announcement_id::VARCHAR AS run_id, CASE id WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'running' END AS status, published_date AS started_at,
    CASE WHEN id IN (1, 2) THEN DATE '1999-01-02' END AS completed_at, (CASE WHEN id = 1 THEN 7 ELSE 0 END)::BIGINT AS records_processed, (CASE WHEN id = 1 THEN 3 ELSE 0 END)::BIGINT AS records_failed,
    CASE WHEN id = 2 THEN 'boom' END AS error_message FROM announcements""",
    "announcements",
)
def _(t: Tables) -> DataFrame:
    """Stored runs, one an announcement, of which one is completed and one fails."""
    runs = t.announcements.select(
        F.col("announcement_id").cast("string").alias("run_id"), F.lit("running").alias("status"), F.col("published_date").alias("started_at"), F.lit(None).cast("date").alias("completed_at"),
        F.lit(0).cast("long").alias("records_processed"), F.lit(0).cast("long").alias("records_failed"), F.lit(None).cast("string").alias("error_message"),
    )
    at = F.lit("1999-01-02").cast("date")
    return stages.fail_run(stages.complete_run(runs, "ANN-1", at, 7, 3), "ANN-2", at, "boom")
