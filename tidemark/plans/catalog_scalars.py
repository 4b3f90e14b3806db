"""Registered queries: scalar functions, sources, set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import labelling
from ..sources import readers
from . import taxonomy as T
from .bridge import Tables
from .registry import query

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TAGS = r"regexp_replace(regexp_replace(regexp_replace({0}, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', '', 'g')"


def _clean_html(x: str) -> str:
    out = _TAGS.format(x)
    for entity, plain in text.ENTITIES:
        out = f"replace({out}, '{entity}', '{plain}')".replace("'''", "''''")
    return f"coalesce({out}, '')"


def _clean(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace({_clean_html(x)}, '{_WS}', ' ', 'g')), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{7f}}-\\x{{9f}}]', '', 'g')"


_HTML_SQL = _clean_html("html").replace("'&#39;', ''')", "'&#39;', '''')")
_CLEAN_SQL = _clean("html").replace("'&#39;', ''')", "'&#39;', '''')")


@query("sc01_clean_html", f"SELECT page_id, {_HTML_SQL} AS text FROM pages")
def _(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


@query("sc02_normalize_whitespace", f"SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


@query("sc03_remove_control_chars", "SELECT id, 'a' || (id % 7) || 'b' AS text FROM (SELECT o_orderkey AS id FROM orders)")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.concat(F.lit("a\x00"), (k % 7).cast("string"), F.lit("\x1f\x85b"))
    return t.raw("orders").select(k.alias("id"), text.remove_control_chars(said).alias("text"))


@query("sc04_clean_text", f"SELECT page_id, {_CLEAN_SQL} AS text FROM pages")
def _(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


@query("sc05_truncate", "SELECT doc_id, substr(text, 1, 2000) AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.truncate(F.col("text")).alias("text"))


@query("sc06_value_as_float", "SELECT announcement_id, field_name, field_value, replace(field_value, ',', '') AS plain, TRY_CAST(replace(field_value, ',', '') AS DOUBLE) AS v FROM eav", "eav")
def _(t: Tables) -> DataFrame:
    v = F.col("field_value")
    return t.fields.select("announcement_id", "field_name", "field_value", F.replace(v, F.lit(","), F.lit("")).alias("plain"), numbers.value_as_float(v).alias("v"))



@query(
    "sc07_parse_number",
    """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_size * 10000.0::DOUBLE WHEN 1 THEN (p_size + 0.5::DOUBLE) * 100000000.0::DOUBLE WHEN 2 THEN p_size / 100.0::DOUBLE WHEN 3 THEN 3100.0::DOUBLE + p_size WHEN 8 THEN p_size::DOUBLE END AS v FROM part""",
)
def _(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit("约"), s, F.lit("万"))).when(k == 1, F.concat(s, F.lit(".5亿"))).when(k == 2, F.concat(s, F.lit("%")))
        .when(k == 3, F.concat(F.lit(" 3,"), (F.col("p_size") + 100).cast("string"), F.lit(" "))).when(k == 4, "1万亿").when(k == 5, F.concat(s, F.lit("万元"))).when(k == 6, "").when(k == 8, F.concat(F.lit("不超过"), s))
    )
    return t.raw("part").select("p_partkey", numbers.parse_number(said).alias("v"))


@query(
    "sc08_normalize_amount",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice * 10000.0::DOUBLE WHEN 1 THEN p_retailprice / 10000.0::DOUBLE ELSE p_retailprice END AS v FROM part",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, " CNY_100M ").when(k == 1, "元").when(k == 2, "wan")
    return t.raw("part").select("p_partkey", numbers.normalize_amount(F.col("p_retailprice"), unit).alias("v"))


@query("sc09_safe_divide", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax, CASE WHEN abs(l_tax) < 1e-10 THEN 0.0::DOUBLE ELSE l_discount / l_tax END AS v FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", numbers.safe_divide(F.col("l_discount"), F.col("l_tax")).alias("v"))


@query("sc10_clamp", "SELECT c_custkey, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, c_acctbal / 5000.0::DOUBLE)) AS v FROM customer")
def _(t: Tables) -> DataFrame:
    return t.raw("customer").select("c_custkey", numbers.clamp(F.col("c_acctbal") / 5000.0, -1.0, 1.0).alias("v"))


@query("sc11_short_code", "SELECT id, replace(replace(stock_code, '.SH', ''), '.SZ', '') AS code FROM companies", "companies")
def _(t: Tables) -> DataFrame:
    return t.companies.select("id", text.short_code(F.col("stock_code")).alias("code"))


@query("sc12_compact_date", "SELECT id, strftime(published_date, '%Y%m%d') AS day FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", dates.compact(F.col("published_date")).alias("day"))


@query("sc13_dashed_date", "SELECT id, strftime(published_date, '%Y-%m-%d') AS day FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", dates.dashed(dates.compact(F.col("published_date"))).alias("day"))


@query("sc14_parse_any_date", "SELECT id, CASE WHEN id % 4 < 3 THEN published_date END AS day FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    k, d = F.col("id") % 4, F.col("published_date")
    said = F.when(k == 0, F.date_format(d, "yyyy-M-d")).when(k == 1, dates.compact(d)).when(k == 2, F.date_format(d, "yyyy-MM-dd 08:30:00")).otherwise("n/a")
    return t.announcements.select("id", dates.parse_any(said).alias("day"))


@query("sc15_parse_compact_date", "SELECT id, published_date AS day FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", dates.parse_compact(dates.compact(F.col("published_date"))).alias("day"))


@query("sc17_weekdays", "SELECT id, isodow(published_date) < 6 AS weekday FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", dates.is_weekday(F.col("published_date")).alias("weekday"))


@query("sc18_previous_trading_day", "SELECT id, (published_date - CASE isodow(published_date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END)::DATE AS day FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", dates.previous_trading_day(F.col("published_date")).alias("day"))


@query(
    "sc19_trading_days",
    "SELECT id, day::DATE AS day FROM (SELECT id, unnest(generate_series(published_date, published_date + 9, INTERVAL 1 DAY)) AS day FROM announcements) WHERE isodow(day) < 6",
    "announcements",
)
def _(t: Tables) -> DataFrame:
    d = F.col("published_date")
    return t.announcements.select("id", F.explode(dates.trading_days(d, F.date_add(d, 9))).alias("day"))


@query("sc20_direction_label", "SELECT announcement_id, CASE WHEN composite_score > 0.1::DOUBLE THEN 'bullish' WHEN composite_score < -0.1::DOUBLE THEN 'bearish' ELSE 'neutral' END AS direction FROM scores", "scores")
def _(t: Tables) -> DataFrame:
    return t.scores.select("announcement_id", numbers.direction_label(F.col("composite_score")).alias("direction"))


@query("sc21_high_impact_flag", "SELECT announcement_id, abs(composite_score) >= 0.5::DOUBLE AS high FROM scores", "scores")
def _(t: Tables) -> DataFrame:
    return t.scores.select("announcement_id", numbers.is_high_impact(F.col("composite_score")).alias("high"))


@query(
    "sc22_format_value",
    r"""SELECT announcement_id, field_name, field_value, CASE WHEN field_type = 'numeric' AND TRY_CAST(replace(field_value, ',', '') AS DOUBLE) IS NOT NULL THEN format('{:,}', TRY_CAST(replace(field_value, ',', '') AS BIGINT)) ELSE coalesce(field_value, '') END AS shown FROM eav""",
    "eav",
)
def _(t: Tables) -> DataFrame:
    return t.fields.select("announcement_id", "field_name", "field_value", numbers.format_value(F.col("field_value"), F.col("field_type")).alias("shown"))


@query("sc24_score_bar", "SELECT announcement_id, round(abs(composite_score) / 1.0::DOUBLE * 100)::BIGINT AS pct FROM scores", "scores")
def _(t: Tables) -> DataFrame:
    return t.scores.select("announcement_id", F.round(F.abs("composite_score") / 1.0 * 100).cast("long").alias("pct"))


@query("sc25_prefixes", "SELECT id, substr(title, 1, 30) AS short, substr(published_date::VARCHAR, 1, 4) AS year FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", F.substring("title", 1, 30).alias("short"), F.substring(F.col("published_date").cast("string"), 1, 4).alias("year"))


@query("sc26_to_json", """SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS detail FROM customer""")
def _(t: Tables) -> DataFrame:
    return t.raw("customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("detail"))


@query("sc27_from_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("sc28_preprocess", "SELECT id, substr(coalesce(nullif(full_text, ''), title), 1, 1536) AS text FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", text.preprocess(F.col("full_text"), F.col("title")).alias("text"))


@query("sc29_title_and_body", "SELECT id, substr(title || chr(10) || coalesce(full_text, ''), 1, 1536) AS text FROM announcements", "announcements")
def _(t: Tables) -> DataFrame:
    return t.announcements.select("id", text.preprocess_title_and_body(F.col("title"), F.col("full_text")).alias("text"))


@query("sc31_taxonomy_counts", "SELECT e.major, count(*) AS n, count(DISTINCT e.sub) AS subs, sum(len(e.fields))::BIGINT AS fields FROM classifications c JOIN events_dim e ON e.sub = c.sub_category GROUP BY e.major", "classifications", "events_dim")
def _(t: Tables) -> DataFrame:
    """Of each major category of the taxonomy: the classified rows, their different sub-categories, and the fields they are to have."""
    events = F.broadcast(T.events_df(t.spark).select("major", F.col("sub").alias("sub_category"), F.size("fields").alias("_n")))
    return t.classifications.select("sub_category").join(events, "sub_category").groupBy("major").agg(F.count("*").alias("n"), F.countDistinct("sub_category").alias("subs"), F.sum("_n").alias("fields"))


@query("sc31_group_members", "SELECT g.industry_group, count(*) AS n, count(DISTINCT c.industry) AS industries FROM companies c JOIN groups_dim g ON g.industry = c.industry GROUP BY ALL", "companies", "groups_dim")
def _(t: Tables) -> DataFrame:
    """Of each industry group: the companies whose industry the registry has, and their different industries."""
    groups = F.broadcast(T.industries_df(t.spark))
    return t.companies.select("industry").join(groups, "industry").groupBy("industry_group").agg(F.count("*").alias("n"), F.countDistinct("industry").alias("industries"))


@query("src01_stock_list", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return readers.table(t.spark, t.folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")


@query("src05_daily_bars", "SELECT l_partkey, l_shipdate::DATE AS trade_date, max(l_extendedprice) AS high, min(l_extendedprice) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return t.raw("lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("trade_date")).agg(F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.sum("l_quantity").alias("volume"))


@query("src09_pagination", "SELECT p_partkey, greatest(1, CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE ceil((p_partkey % 400) / 50.0)::INT END)::INT AS pages FROM part")
def _(t: Tables) -> DataFrame:
    told = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size"))
    return t.raw("part").select("p_partkey", readers.total_pages(told, F.col("p_partkey") % 400).cast("int").alias("pages"))


@query(
    "src09_list_pages",
    """SELECT c_custkey::VARCHAR AS company_code, p + 1 AS page_index, i AS item_index, 'A' || (c_custkey * 100 + p * 10 + i) AS art_code FROM customer, range(4) r(p), range(3) q(i)
    WHERE p + 1 <= 3 AND (c_custkey % 2 <> 0 OR p < 1)""",
)
def _(t: Tables) -> DataFrame:
    """Four JSON pages a company of 120 hits, of which three count; of every other company the second page is empty, so only the first counts."""
    k = F.col("c_custkey")
    pages = t.raw("customer").select(k, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p"))
    item = lambda i: F.struct(F.concat(F.lit("A"), (k * 100 + F.col("p") * 10 + i).cast("string")).alias("art_code"), F.lit("t").alias("title"), F.lit("").alias("notice_date"), F.lit("").alias("notice_content"))
    listed = F.transform(F.sequence(F.lit(0), F.lit(2)), item)
    empty = (k % 2 == 0) & (F.col("p") == 1)
    data = F.struct((F.col("p") + 1).alias("page_index"), F.lit(50).alias("page_size"), F.lit(120).alias("total_hits"), F.when(~empty, listed).otherwise(F.slice(listed, 1, 0)).alias("list"))
    payload = pages.select(k.cast("string").alias("company_code"), (F.col("p") + 1).cast("long").alias("page_index"), F.to_json(F.struct(data.alias("data"))).alias("payload"))
    return readers.list_items(payload).select("company_code", "page_index", F.col("item_index").cast("long").alias("item_index"), "art_code")


@query(
    "src12_fetch_window",
    """SELECT 'A' || (o_orderkey // 2) AS announcement_id, company_id, o_orderkey::VARCHAR AS title, CASE WHEN (o_orderkey // 2) % 3 = 0 THEN 'body of ' || (o_orderkey // 2) ELSE 'summary' END AS full_text, day AS published_date
    FROM (SELECT o_orderkey, o_custkey AS company_id, CASE WHEN o_orderkey % 4 = 3 THEN DATE '1996-06-30' ELSE o_orderdate::DATE END AS day FROM orders)
    WHERE company_id IN (SELECT id FROM companies WHERE is_tracked) AND day BETWEEN DATE '1996-06-20' AND DATE '1996-06-30'
    QUALIFY row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY company_id, o_orderkey) = 1""",
    "companies",
)
def _(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    day = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "yyyyMMdd")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd 10:00:00")).otherwise("later")
    half = F.floor(k / 2).cast("string")
    items = t.raw("orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("company_code"), F.lit(1).alias("page_index"), k.alias("item_index"), F.concat(F.lit("A"), half).alias("art_code"),
        k.cast("string").alias("title"), day.alias("notice_date"), F.lit("summary").alias("notice_content"),
    )
    contents = t.raw("orders").where(F.floor(k / 2) % 3 == 0).select(F.concat(F.lit("A"), half).alias("art_code"), F.concat(F.lit("<p>body of "), half, F.lit("</p>")).alias("notice_content"), F.lit("").alias("attach_url_web"), F.lit("u").alias("attach_url")).distinct()
    got = readers.announcements_from(items, contents, t.companies, dt.date(1996, 6, 30), 10)
    return got.select("announcement_id", "company_id", "title", "full_text", "published_date")


@query(
    "src13_latest_financials",
    """SELECT i.o_custkey AS ts_code, i.o_totalprice AS annual_revenue, floor(i.o_totalprice / 10)::BIGINT AS net_profit, b.net_assets FROM
    (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) i
    LEFT JOIN (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS net_assets FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL) b ON b.o_custkey = i.o_custkey""",
)
def _(t: Tables) -> DataFrame:
    o = t.raw("orders").withColumn("end_date", F.struct("o_orderdate", "o_orderkey"))
    income = o.select(F.col("o_custkey").alias("ts_code"), "end_date", F.col("o_totalprice").alias("revenue"), F.floor(F.col("o_totalprice") / 10).alias("n_income"))
    balance = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("ts_code"), "end_date", F.col("o_orderkey").alias("net_assets"))
    return readers.latest_financials(income, balance)


@query(
    "src14_seed_companies",
    "SELECT stock_code, stock_name, CASE WHEN ends_with(stock_code, '.SH') THEN 'SSE' ELSE 'SZSE' END AS exchange, industry, coalesce(contains(industry, '制药') OR contains(industry, '电'), false) AS is_tracked FROM companies",
    "companies",
)
def _(t: Tables) -> DataFrame:
    stocks = t.companies.select(F.col("stock_code").alias("ts_code"), F.col("stock_name").alias("name"), "industry")
    return readers.seed_companies(stocks, ["制药", "电"])


_LABELLED = """(SELECT doc_id AS place, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'L' || (doc_id % 400) END AS announcement_id, CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'text ' || (doc_id % 350) END AS text,
 CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'no_such_sub' WHEN 2 THEN 'buyback' WHEN 3 THEN 'penalty' ELSE 'bid_win' END AS sub_category FROM documents)"""


def _labelled(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return t.raw("documents").select(
        k.alias("place"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("L"), (k % 400).cast("string"))).alias("announcement_id"),
        F.when(k % 29 == 0, "").otherwise(F.concat(F.lit("text "), (k % 350).cast("string"))).alias("text"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, "no_such_sub").when(k % 7 == 2, "buyback").when(k % 7 == 3, "penalty").otherwise("bid_win").alias("sub_category"),
        F.lit(None).cast("string").alias("major_category"),
    )


@query("src15_labelled_majors", f"SELECT place, sub_category, coalesce(NULL, substr(sub_category, 1, 1)) AS major_category FROM {_LABELLED}")
def _(t: Tables) -> DataFrame:
    return labelling.with_major(_labelled(t)).select("place", "sub_category", "major_category")


@query("src17_table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000")
def _(t: Tables) -> DataFrame:
    return readers.table(t.spark, t.folder, "customer").where("c_acctbal > 9000").select("c_custkey", "c_name", "c_acctbal")


@query("set01_bag_union", "SELECT 0 AS source, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark")
def _(t: Tables) -> DataFrame:
    a = t.raw("documents").select(F.lit(0).alias("source"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(t.raw("benchmark").select(F.lit(1).alias("source"), F.col("item_id").alias("id"), "text"))


# one row after the other, with the keys kept before it
_WALK = f"""WITH RECURSIVE rows_ AS (SELECT row_number() OVER (ORDER BY place) AS n, place, coalesce(nullif(announcement_id, ''), 'text:' || text) AS k, text FROM {_LABELLED} WHERE sub_category IN (SELECT sub FROM events_dim) AND text <> ''),
    walk(n, ks, ts, place, kept) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], -1::BIGINT, false
      UNION ALL SELECT r.n, CASE WHEN list_contains(w.ks, r.k) OR list_contains(w.ts, r.text) THEN w.ks ELSE list_append(w.ks, r.k) END,
        CASE WHEN list_contains(w.ks, r.k) OR list_contains(w.ts, r.text) THEN w.ts ELSE list_append(w.ts, r.text) END, r.place, NOT (list_contains(w.ks, r.k) OR list_contains(w.ts, r.text))
      FROM walk w JOIN rows_ r ON r.n = w.n + 1)"""


@query(
    "set02_first_wins",
    f"{_WALK} SELECT place FROM walk WHERE kept",
    "events_dim",
)
def _(t: Tables) -> DataFrame:
    return labelling.first_wins(labelling.candidates(_labelled(t))).select("place")


@query("set03_first_company_wins", "SELECT o_orderpriority AS art_code, min(o_custkey) AS company_id FROM orders GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy(F.col("o_orderpriority").alias("art_code")).agg(F.min("o_custkey").alias("company_id"))


@query(
    "set04_template_difference",
    f"SELECT DISTINCT sub_category, 'unknown' AS side FROM {_LABELLED} WHERE sub_category NOT IN (SELECT sub FROM events_dim) UNION ALL SELECT sub, 'missing' FROM events_dim WHERE sub NOT IN (SELECT sub_category FROM {_LABELLED})",
    "events_dim",
)
def _(t: Tables) -> DataFrame:
    return labelling.template_difference(_labelled(t))


@query("set05_label_union", "SELECT quality AS label FROM labels UNION SELECT toxic FROM labels")
def _(t: Tables) -> DataFrame:
    n = t.raw("labels")
    return n.select(F.col("quality").alias("label")).union(n.select("toxic")).distinct()


def _statements(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ts_code"), F.to_date("o_orderdate").alias("end_date"), F.col("o_orderstatus").alias("report_type"), F.col("o_totalprice").alias("revenue"))


_STATEMENTS = "(SELECT 'C' || o_custkey AS ts_code, o_orderdate::DATE AS end_date, o_orderstatus AS report_type, o_totalprice AS revenue FROM orders)"


@query("src02_disclosure_calendar", f"SELECT ts_code, end_date FROM {_STATEMENTS} WHERE end_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
def _(t: Tables) -> DataFrame:
    return readers.vendor_rows(_statements(t), ts_code="", start_date=dt.date(1996, 1, 1), end_date=dt.date(1996, 3, 31)).select("ts_code", "end_date")


@query("src03_income", f"SELECT * FROM {_STATEMENTS} WHERE ts_code = 'C7' AND report_type = 'O'")
def _(t: Tables) -> DataFrame:
    return readers.vendor_rows(_statements(t), ts_code="C7", report_type="O", start_date=None)


@query("src04_balance_sheet", f"SELECT * FROM {_STATEMENTS} WHERE end_date >= DATE '2000-01-01'")
def _(t: Tables) -> DataFrame:
    return readers.vendor_rows(_statements(t), start_date=dt.date(2000, 1, 1))


@query("src06_former_names", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def _(t: Tables) -> DataFrame:
    return readers.vendor_rows(t.raw("supplier").select("s_suppkey", "s_name", "s_nationkey"), s_nationkey=3).select("s_suppkey", "s_name")


@query(
    "sc23_signed_scores",
    """SELECT announcement_id, format('{:+.3f}', composite_score) AS composite, format('{:+.2f}', direction) AS direction, format('{:.2f}', magnitude) AS magnitude, format('{:.0f}%', confidence * 100) AS confidence
    FROM scores LEFT JOIN classifications USING (announcement_id)""",
    "scores", "classifications",
)
def _(t: Tables) -> DataFrame:
    df = t.scores.join(t.classifications.select("announcement_id", "confidence"), "announcement_id", "left")
    show = lambda c, n, plus=False: numbers.fixed(F.col(c), n, plus)
    return df.select("announcement_id", show("composite_score", 3, True).alias("composite"), show("direction", 2, True).alias("direction"), show("magnitude", 2).alias("magnitude"), F.concat(numbers.fixed(F.col("confidence") * 100, 0), F.lit("%")).alias("confidence"))


@query(
    "src08_page_request",
    """SELECT c_custkey, 50 AS page_size, ((c_custkey % 3) + 1)::INT AS page_index, 'A' AS ann_type, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::VARCHAR END AS stock_list,
    CASE WHEN c_custkey % 5 <> 0 THEN '1996-01-01' END AS begin_time, NULL::VARCHAR AS end_time FROM customer""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".SH"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".SZ"))).otherwise(k.cast("string"))
    request = readers.page_request(code, k % 3 + 1, F.when(k % 5 == 0, "").otherwise("1996-01-01"))
    return t.raw("customer").select("c_custkey", request.alias("r")).select("c_custkey", "r.*")


_REGISTRY = [("metals", ("steel", "copper")), ("food", ("BUILDING", "MACHINERY"))]


@query("src16_registry_groups", f"SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'food' ELSE '{T.DEFAULT_GROUP}' END AS industry_group FROM customer")
def _(t: Tables) -> DataFrame:
    """The groups of a registry other than the built-in one."""
    pairs = [(i, g) for g, own in _REGISTRY for i in own]
    return t.raw("customer").select("c_custkey", T.resolve_group(F.col("c_mktsegment"), pairs).alias("industry_group"))
