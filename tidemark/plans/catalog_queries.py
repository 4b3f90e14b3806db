"""Registered queries: filters, joins, aggregations, sorts and limits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..operators import report, search, stats
from ..operators.search import Filters
from . import labels
from . import taxonomy as T
from .bridge import Tables
from .registry import query

_A = "id, company_id, announcement_id, title, full_text, published_date, processing_status, error_message"
START, END = dt.date(1995, 1, 1), dt.date(1999, 12, 31)
_GROUP = "消费"


def _filtered(t: Tables, **f: object) -> DataFrame:
    return search.filtered(t.announcements, t.classifications, t.scores, Filters(**f))


_IN = "DATE '1995-01-01' AND DATE '1999-12-31'"
_ALL = f"""published_date BETWEEN {_IN} AND processing_status = 'scored' AND title ILIKE '%urgent%'
AND id IN (SELECT announcement_id FROM classifications WHERE industry_group = '{_GROUP}') AND id IN (SELECT announcement_id FROM scores WHERE composite_score < -0.1::DOUBLE)"""


@query("flt01_composed_filter", f"SELECT {_A} FROM announcements WHERE {_ALL}", "announcements", "classifications", "scores")
def _(t: Tables) -> DataFrame:
    return _filtered(t, start_date=START, end_date=END, status="scored", keyword="urgent", industry_group=_GROUP, direction="bearish")


@query("flt01_keyword_wildcard", f"SELECT {_A} FROM announcements WHERE title ILIKE '%1_urg%notice%'", "announcements")
def _(t: Tables) -> DataFrame:
    return _filtered(t, keyword="1_urg%notice")


for _name, _cond in (("bullish", "composite_score > 0.1::DOUBLE"), ("bearish", "composite_score < -0.1::DOUBLE"), ("sideways", "abs(composite_score) <= 0.1::DOUBLE")):
    query(f"flt02_direction_{_name}", f"SELECT {_A} FROM announcements WHERE id IN (SELECT announcement_id FROM scores WHERE {_cond})", "announcements", "scores")(
        lambda t, d=_name: _filtered(t, direction=d)
    )


@query("flt03_status_scan", f"SELECT {_A} FROM announcements WHERE processing_status = 'extracted' ORDER BY id LIMIT 200", "announcements")
def _(t: Tables) -> DataFrame:
    return search.by_status(t.announcements, "extracted", 200)


@query("flt04_date_range", f"SELECT {_A} FROM announcements WHERE published_date BETWEEN {_IN} AND processing_status = 'reported'", "announcements")
def _(t: Tables) -> DataFrame:
    return _filtered(t, start_date=START, end_date=END, status="reported")


@query("flt05_point_lookup", "SELECT * FROM companies WHERE stock_code = '000042.SH'", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.where(F.col("stock_code") == "000042.SH")


@query("flt06_tracked_of_industry", "SELECT id, stock_code FROM companies WHERE is_tracked AND industry = '白酒'", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.where("is_tracked").where(F.col("industry") == "白酒").select("id", "stock_code")


@query("flt07_codes", "SELECT stock_code FROM companies WHERE is_tracked", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.where("is_tracked").select("stock_code")


@query("flt08_high_impact", "SELECT announcement_id, composite_score FROM scores WHERE abs(composite_score) >= 0.5::DOUBLE", "scores")
def _(t: Tables) -> DataFrame:
    return t.scores.where(numbers.is_high_impact(F.col("composite_score"))).select("announcement_id", "composite_score")


@query("flt09_whole_market", "SELECT id, stock_code FROM companies WHERE industry IS NULL OR industry = ''", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.where(F.col("industry").isNull() | (F.col("industry") == "")).select("id", "stock_code")


@query("flt10_confidence_gate", "SELECT announcement_id, sub_category, confidence FROM classifications WHERE confidence >= 0.6::DOUBLE ORDER BY announcement_id LIMIT 200", "classifications")
def _(t: Tables) -> DataFrame:
    from ..operators.extraction import gated

    return gated(t.classifications, limit=200).select("announcement_id", "sub_category", "confidence")


@query("flt11_first_companies", "SELECT id, stock_code FROM companies WHERE is_tracked ORDER BY id LIMIT 10", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.where("is_tracked").orderBy("id").limit(10).select("id", "stock_code")


@query("flt12_minimum_length", "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text)) >= 500")
def _(t: Tables) -> DataFrame:
    n = F.length(F.trim("text"))
    return t.raw("documents").where(n >= 500).select("doc_id", n.cast("long").alias("n"))


_TEXTS = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '' WHEN 2 THEN 'soon' END"


@query("flt13_optional_date", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE END AS day FROM orders")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, "").when(k == 2, "soon")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), dates.optional_date(said).alias("day"))


@query("flt16_contains_any", "SELECT id, industry FROM companies WHERE coalesce(regexp_matches(industry, '酒|银行'), false)", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.where(F.coalesce(F.col("industry").rlike("酒|银行"), F.lit(False))).select("id", "industry")


@query("flt17_not_null_counts", "SELECT count(industry) AS industry, count(annual_revenue) AS annual_revenue, count(net_assets) AS net_assets FROM companies", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.agg(*[F.count(c).alias(c) for c in ("industry", "annual_revenue", "net_assets")])


@query("jn01_by_major", "SELECT a.id, c.sub_category FROM announcements a JOIN classifications c ON c.announcement_id = a.id WHERE c.major_category = 'C'", "announcements", "classifications")
def _(t: Tables) -> DataFrame:
    c = t.classifications.where(F.col("major_category") == "C").select(F.col("announcement_id").alias("id"), "sub_category")
    return t.announcements.select("id").join(c, "id")


@query("jn02_scored", "SELECT a.id, s.composite_score FROM announcements a JOIN scores s ON s.announcement_id = a.id", "announcements", "scores")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id").join(t.scores.select(F.col("announcement_id").alias("id"), "composite_score"), "id")


@query(
    "jn03_details",
    f"""SELECT a.{_A.replace(', ', ', a.')}, co.stock_code, co.stock_name, co.industry, c.major_category, c.sub_category, c.confidence, c.industry_group,
    s.direction, s.magnitude, s.surprise, s.credibility, s.composite_score FROM announcements a LEFT JOIN companies co ON co.id = a.company_id
    LEFT JOIN classifications c ON c.announcement_id = a.id LEFT JOIN scores s ON s.announcement_id = a.id""",
    "announcements", "companies", "classifications", "scores",
)
def _(t: Tables) -> DataFrame:
    return search.details(t.announcements, t.companies, t.classifications, t.scores)


@query("jn03_with_fields", "SELECT a.id, count(l.field_name) AS n_fields FROM announcements a LEFT JOIN last_fields l ON l.announcement_id = a.id GROUP BY a.id", "announcements", "last_fields")
def _(t: Tables) -> DataFrame:
    f = t.field_map.select(F.col("announcement_id").alias("id"), F.size("fields").alias("n"))
    return t.announcements.select("id").join(f, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_fields"))


@query("jn04_company_of", "SELECT a.id, c.industry FROM announcements a LEFT JOIN companies c ON c.id = a.company_id", "announcements", "companies")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", "company_id").join(t.companies.select(F.col("id").alias("company_id"), "industry"), "company_id", "left").select("id", "industry")


@query(
    "jn06_report_rows",
    """SELECT a.id AS announcement_id, a.title, s.composite_score, c.sub_category, co.stock_name FROM announcements a JOIN scores s ON s.announcement_id = a.id
    LEFT JOIN classifications c ON c.announcement_id = a.id LEFT JOIN companies co ON co.id = a.company_id""",
    "announcements", "scores", "classifications", "companies",
)
def _(t: Tables) -> DataFrame:
    return report.items(t.announcements, t.scores, t.classifications, t.companies).select("announcement_id", "title", "composite_score", "sub_category", "stock_name")


@query("jn07_taxonomy_lookup", "SELECT c.announcement_id, e.sub_label, e.direction_baseline, len(e.fields)::INT AS n FROM classifications c LEFT JOIN events_dim e ON e.sub = c.sub_category", "classifications", "events_dim")
def _(t: Tables) -> DataFrame:
    ev = F.broadcast(T.events_df(t.spark).select(F.col("sub").alias("sub_category"), "sub_label", "direction_baseline", F.size("fields").alias("n")))
    return t.classifications.join(ev, "sub_category", "left").select("announcement_id", "sub_label", "direction_baseline", "n")


@query("jn08_industry_group", f"SELECT c.id, coalesce(g.industry_group, '{T.DEFAULT_GROUP}') AS industry_group FROM companies c LEFT JOIN groups_dim g ON g.industry = c.industry", "companies", "groups_dim")
def _(t: Tables) -> DataFrame:
    return t.companies.select("id", T.resolve_group(F.col("industry")).alias("industry_group"))


_LABELS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in labels.FIELD_LABELS.items()) + ") AS l(name, said)"


@query("jn09_labels", f"SELECT DISTINCT field_name, coalesce(said, field_name) AS label FROM eav LEFT JOIN {_LABELS} ON name = field_name", "eav")
def _(t: Tables) -> DataFrame:
    names = t.fields.select("field_name").distinct()
    return names.select("field_name", T.label(F.col("field_name"), labels.FIELD_LABELS).alias("label"))


@query("jn10_code_to_id", "SELECT s.s_suppkey, c.id FROM supplier s JOIN companies c ON c.stock_code = lpad((s.s_suppkey * 3)::VARCHAR, 6, '0') || '.SH'", "companies")
def _(t: Tables) -> DataFrame:
    s = t.raw("supplier").select("s_suppkey", F.concat(F.lpad((F.col("s_suppkey") * 3).cast("string"), 6, "0"), F.lit(".SH")).alias("stock_code"))
    return s.join(t.companies.select("id", "stock_code"), "stock_code").select("s_suppkey", "id")


@query("jn11_not_labelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id").join(t.raw("labels").select("doc_id"), "doc_id", "left_anti")


@query("jn12_known_category", "SELECT p_partkey, p_type FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 48)")
def _(t: Tables) -> DataFrame:
    p = t.raw("part")
    return p.join(p.where("p_size > 48").select("p_brand"), "p_brand", "left_semi").select("p_partkey", "p_type")


@query("agg01_counts", "SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM announcements) AS announcements", "companies", "announcements")
def _(t: Tables) -> DataFrame:
    one = t.companies.select(F.lit(1).alias("c"), F.lit(0).alias("a")).unionByName(t.announcements.select(F.lit(0).alias("c"), F.lit(1).alias("a")))
    return one.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("companies"), F.coalesce(F.sum("a"), F.lit(0)).alias("announcements"))


@query("agg02_count_of_status", "SELECT count(*) AS n FROM announcements WHERE processing_status = 'failed'", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.where(F.col("processing_status") == "failed").agg(F.count("*").alias("n"))


@query("agg03_status_histogram", "SELECT processing_status, count(*) AS n FROM announcements GROUP BY ALL", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.groupBy("processing_status").agg(F.count("*").alias("n"))


_STATUS = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(T.STATUSES)) + ") AS v(place, status)"


@query("agg04_status_overview", f"SELECT place, status, (SELECT count(*) FROM announcements WHERE processing_status = status) AS n FROM {_STATUS}", "announcements")
def _(t: Tables) -> DataFrame:
    return stats.status_overview(t.announcements)


@query("agg05_category_distribution", "SELECT major_category, count(*) AS n FROM classifications GROUP BY ALL", "classifications")
def _(t: Tables) -> DataFrame:
    return stats.distribution(t.classifications, "major_category")


@query("agg06_industry_distribution", "SELECT industry_group, count(*) AS n FROM classifications WHERE industry_group IS NOT NULL GROUP BY ALL", "classifications")
def _(t: Tables) -> DataFrame:
    return stats.distribution(t.classifications, "industry_group", skip_null=True)


@query(
    "agg07_direction_distribution",
    """SELECT 'bullish' AS direction, count(*) AS n FROM scores WHERE composite_score > 0.1::DOUBLE UNION ALL SELECT 'bearish', count(*) FROM scores WHERE composite_score < -0.1::DOUBLE
    UNION ALL SELECT 'neutral', count(*) FROM scores WHERE abs(composite_score) <= 0.1::DOUBLE""",
    "scores",
)
def _(t: Tables) -> DataFrame:
    return stats.direction_distribution(t.scores)


@query("agg08_high_impact_count", "SELECT count(*) AS n FROM scores WHERE abs(composite_score) >= 0.5::DOUBLE", "scores")
def _(t: Tables) -> DataFrame:
    return t.scores.agg(F.count_if(numbers.is_high_impact(F.col("composite_score"))).alias("n"))


@query("agg09_industries", "SELECT DISTINCT industry FROM companies WHERE industry <> ''", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.where(F.col("industry") != "").select("industry").distinct()


@query("agg10_filtered_total", f"SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS total_pages FROM announcements WHERE {_ALL}", "announcements", "classifications", "scores")
def _(t: Tables) -> DataFrame:
    return search.count_pages(_filtered(t, start_date=START, end_date=END, status="scored", keyword="urgent", industry_group=_GROUP, direction="bearish"))


@query("agg11_pages_of_none", "SELECT 0::BIGINT AS total, 1::BIGINT AS total_pages")
def _(t: Tables) -> DataFrame:
    return search.count_pages(_filtered(t, keyword="no such word"))


_ITEMS = "(SELECT s.*, a.title, a.company_id, c.major_category, c.sub_category, c.industry_group, co.industry, co.stock_name, co.stock_code FROM announcements a JOIN scores s ON s.announcement_id = a.id LEFT JOIN classifications c ON c.announcement_id = a.id LEFT JOIN companies co ON co.id = a.company_id)"
_ITEM_VIEWS = ("announcements", "scores", "classifications", "companies", "groups_dim")


def _items(t: Tables) -> DataFrame:
    return report.items(t.announcements, t.scores, t.classifications, t.companies)


@query(
    "agg12_report_totals",
    f"""SELECT *, total - bullish - bearish AS neutral FROM (SELECT count(*) AS total, count(*) FILTER (abs(composite_score) >= 0.5::DOUBLE) AS high,
    count(*) FILTER (composite_score > 0.1::DOUBLE) AS bullish, count(*) FILTER (composite_score < -0.1::DOUBLE) AS bearish FROM {_ITEMS})""",
    *_ITEM_VIEWS,
)
def _(t: Tables) -> DataFrame:
    return stats.report_totals(_items(t))


@query("agg13_report_categories", f"SELECT major_category || '-' || sub_category AS category, count(*) AS n FROM {_ITEMS} WHERE sub_category IS NOT NULL GROUP BY ALL", *_ITEM_VIEWS)
def _(t: Tables) -> DataFrame:
    return report.categories(_items(t))


@query("agg14_report_industries", f"SELECT coalesce(nullif(i.industry_group, ''), g.industry_group, '{T.DEFAULT_GROUP}') AS industry_group, count(*) AS n FROM {_ITEMS} i LEFT JOIN groups_dim g ON g.industry = i.industry GROUP BY 1", *_ITEM_VIEWS)
def _(t: Tables) -> DataFrame:
    return report.industry_groups(_items(t))


@query("agg15_field_pivot", "SELECT announcement_id, field_name, v, CASE WHEN field_type = 'numeric' THEN v IS NOT NULL ELSE field_value IS NOT NULL END AS present FROM last_fields", "last_fields")
def _(t: Tables) -> DataFrame:
    return t.field_map.select("announcement_id", F.explode("fields").alias("field_name", "f")).select("announcement_id", "field_name", "f.v", "f.present")


@query("agg16_value_counts", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY ALL ORDER BY n DESC, p_brand LIMIT 20")
def _(t: Tables) -> DataFrame:
    return t.raw("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types")).orderBy(F.desc("n"), "p_brand").limit(20)


@query("agg16_by_year", "SELECT substr(published_date::VARCHAR, 1, 4) AS year, count(*) AS n FROM announcements GROUP BY ALL", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.groupBy(F.substring(F.col("published_date").cast("string"), 1, 4).alias("year")).agg(F.count("*").alias("n"))


@query(
    "agg17_completeness",
    """SELECT c.announcement_id, count(l.field_name) FILTER (CASE WHEN l.field_type = 'numeric' THEN l.v IS NOT NULL ELSE l.field_value IS NOT NULL END) / max(len(e.fields))::DOUBLE AS completeness
    FROM classifications c JOIN events_dim e ON e.sub = c.sub_category LEFT JOIN last_fields l ON l.announcement_id = c.announcement_id AND list_contains(e.fields, l.field_name) GROUP BY c.announcement_id""",
    "classifications", "events_dim", "last_fields",
)
def _(t: Tables) -> DataFrame:
    from ..operators import scoring

    ev = F.broadcast(T.events_df(t.spark).select(F.col("sub").alias("sub_category"), F.col("fields").alias("expected")))
    df = t.classifications.select("announcement_id", "sub_category").join(ev, "sub_category").join(t.field_map, "announcement_id", "left")
    return df.select("announcement_id", scoring.completeness(F.col("expected")).alias("completeness"))


@query("agg18_run_counters", "SELECT count(*) FILTER (processing_status <> 'failed') AS processed, count(*) FILTER (processing_status = 'failed') AS failed FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    bad = F.col("processing_status") == "failed"
    return t.announcements.agg(F.count_if(~bad).alias("processed"), F.count_if(bad).alias("failed"))


@query(
    "ord01_search_page",
    f"""SELECT a.{_A.replace(', ', ', a.')}, s.composite_score, CASE WHEN s.composite_score > 0.1::DOUBLE THEN 'bullish' WHEN s.composite_score < -0.1::DOUBLE THEN 'bearish' WHEN s.composite_score IS NOT NULL THEN 'neutral' END AS direction
    FROM (SELECT * FROM announcements WHERE title ILIKE '%urgent%' ORDER BY published_date DESC, id DESC LIMIT 20 OFFSET 20) a LEFT JOIN scores s ON s.announcement_id = a.id""",
    "announcements", "scores",
)
def _(t: Tables) -> DataFrame:
    return search.search(t.announcements, t.classifications, t.scores, Filters(keyword="urgent"), 2, 20)


@query("ord01_next_page", f"SELECT {_A} FROM announcements ORDER BY published_date DESC, id DESC LIMIT 20 OFFSET 20", "announcements")
def _(t: Tables) -> DataFrame:
    """The page after the last row of the first one, by seeking."""
    last = search.page(t.announcements).agg(F.min(F.struct("published_date", "id")).alias("l")).first()["l"]
    return search.page_after(t.announcements, last["published_date"], last["id"]).select(*_A.split(", "))


@query("ord01_deep_page", f"SELECT {_A} FROM announcements ORDER BY published_date DESC, id DESC LIMIT 20 OFFSET 1000", "announcements")
def _(t: Tables) -> DataFrame:
    """Page 51 by the stored starts of all pages."""
    return search.deep_page(t.announcements, search.page_starts(t.announcements), 51).select(*_A.split(", "))


@query("ord02_strongest", "SELECT announcement_id, composite_score FROM scores WHERE abs(composite_score) >= 0.5::DOUBLE ORDER BY abs(composite_score) DESC, announcement_id LIMIT 50", "scores")
def _(t: Tables) -> DataFrame:
    return search.high_impact(t.scores).select("announcement_id", "composite_score")


@query("ord04_numbered_top", f"SELECT announcement_id, row_number() OVER (ORDER BY abs(composite_score) DESC, announcement_id)::INT AS place FROM {_ITEMS} ORDER BY place LIMIT 20", *_ITEM_VIEWS)
def _(t: Tables) -> DataFrame:
    return report.ranked(_items(t), 20).select("announcement_id", "place")


@query("ord05_recent", "SELECT id, published_date FROM announcements ORDER BY published_date DESC, id LIMIT 50", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.orderBy(F.desc("published_date"), "id").limit(50).select("id", "published_date")


@query("ord06_bodies_first", "SELECT id, full_text IS NULL AS no_body FROM announcements ORDER BY full_text IS NULL, published_date DESC, id LIMIT 200", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.orderBy(F.col("full_text").isNull(), F.desc("published_date"), "id").limit(200).select("id", F.col("full_text").isNull().alias("no_body"))


@query("ord07_latest_per_company", "SELECT company_id, max_by(id, (published_date, id)) AS id FROM announcements GROUP BY ALL", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.groupBy("company_id").agg(F.max_by("id", F.struct("published_date", "id")).alias("id"))


@query("ord10_label_ids", "SELECT p_type AS label, row_number() OVER (ORDER BY p_type) - 1 AS label_id FROM (SELECT DISTINCT p_type FROM part)")
def _(t: Tables) -> DataFrame:
    from ..operators.labelling import label_ids

    return label_ids(t.raw("part").select(F.col("p_type").alias("sub_category")))
