"""Domain tables derived from the provided star schema, as DataFrames and as the same SQL, so that both engines share inputs.

Keys of orders, customers, documents and pages are unique; (order, line) is not, so a total order over all columns stands in for
a row id wherever one row of several is taken.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from . import taxonomy as T

_SUBS = [e.sub for e in T.events()]
_INDUSTRIES = [i for i, _ in T.industries()]
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _list(values: list) -> Column:
    return F.array(*map(F.lit, values))


class Tables:
    """The domain tables over one folder; each is built when first asked for and stays lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @functools.cached_property
    def companies(self) -> DataFrame:
        k = F.col("c_custkey")
        industry = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, "").when(k % 19 == 0, "unmapped").otherwise(F.get(_list(_INDUSTRIES), (k % len(_INDUSTRIES)).cast("int")))
        return self.raw("customer").select(
            k.alias("id"),
            F.concat(F.lpad(k.cast("string"), 6, "0"), F.when(k % 2 == 0, ".SH").otherwise(".SZ")).alias("stock_code"),
            F.col("c_name").alias("stock_name"),
            industry.alias("industry"),
            F.when(k % 11 != 0, F.floor("c_acctbal")).alias("annual_revenue"),
            F.when(k % 7 != 0, F.floor(F.col("c_acctbal") / 2.0)).alias("net_assets"),
            (k % 3 == 0).alias("is_tracked"),
        )

    @functools.cached_property
    def announcements(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("id"),
            F.col("o_custkey").alias("company_id"),
            F.concat(F.lit("ANN-"), k.cast("string")).alias("announcement_id"),
            F.concat(F.col("o_orderpriority"), F.lit(" notice "), (k % 97).cast("string")).alias("title"),
            F.when(k % 5 != 0, F.concat(F.lit("body "), (k % 1000).cast("string"))).alias("full_text"),
            F.to_date("o_orderdate").alias("published_date"),
            F.get(_list(list(T.STATUSES)), (k % 7).cast("int")).alias("processing_status"),
            F.when(k % 7 == 6, "failed before").alias("error_message"),
        )

    @functools.cached_property
    def classifications(self) -> DataFrame:
        """One an announcement, but for every tenth; industry and group of its company."""
        k = F.col("o_orderkey")
        o = self.raw("orders").where(k % 10 != 9).select(
            k.alias("announcement_id"), F.col("o_custkey").alias("id"), F.get(_list(_SUBS), (k % len(_SUBS)).cast("int")).alias("sub_category"), (((k * 7919) % 1000) / F.lit(1000.0)).alias("confidence")
        )
        c = o.join(self.companies.select("id", "industry"), "id", "left")
        major = F.try_element_at(T.literal_map({e.sub: e.major for e in T.events()}), F.col("sub_category"))
        return c.select("announcement_id", major.alias("major_category"), "sub_category", "confidence", "industry", T.resolve_group(F.col("industry")).alias("industry_group"))

    @functools.cached_property
    def scores(self) -> DataFrame:
        """One an order, from its first line by the total order; no order key of lineitem is left out."""
        first = self.raw("lineitem").groupBy("l_orderkey").agg(F.min(F.struct(*LINE)).alias("l"))
        df = first.select(
            F.col("l_orderkey").alias("announcement_id"),
            (F.col("l.l_discount") * 20.0 - 1.0).alias("direction"),
            (F.col("l.l_quantity") / 50.0).alias("magnitude"),
            (F.col("l.l_tax") * 10.0).alias("surprise"),
            F.lit(0.9).alias("credibility"),
        )
        return df.withColumn("composite_score", F.col("direction") * F.col("magnitude") * F.col("surprise") * F.col("credibility"))

    @functools.cached_property
    def fields(self) -> DataFrame:
        """EAV rows: the field is one of the sub-category's by line number; values are numbers, texts that say none, and nulls."""
        ev = T.events_df(self.spark).select(F.col("sub").alias("_sub"), F.col("fields").alias("_fields"))
        sub = F.get(_list(_SUBS), (F.col("l_orderkey") % len(_SUBS)).cast("int"))
        li = self.raw("lineitem").withColumn("_sub", sub).join(F.broadcast(ev), "_sub")
        m = F.col("l_partkey") % 7
        value = F.when(m == 0, F.lit(None)).when(m == 1, "15%").when(m == 2, "3,000").when(m == 3, F.floor("l_extendedprice").cast("string")).otherwise((F.col("l_quantity").cast("long") - 25).cast("string"))
        return li.select(
            F.col("l_orderkey").alias("announcement_id"),
            F.get("_fields", F.pmod(F.col("l_linenumber"), F.size("_fields"))).alias("field_name"),
            value.alias("field_value"),
            F.when(F.col("l_suppkey") % 3 == 0, "text").otherwise("numeric").alias("field_type"),
            F.struct(*LINE).alias("row_order"),
        )

    @functools.cached_property
    def field_map(self) -> DataFrame:
        return scoring.field_map(self.fields, F.col("row_order"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_EVENTS = "(VALUES " + ", ".join(f"('{e.major}', '{e.major_label}', '{e.sub}', '{e.label}', {e.baseline}::DOUBLE, {_sql_list(e.fields)})" for e in T.events()) + ") AS v(major, major_label, sub, sub_label, direction_baseline, fields)"
_GROUPS = "(VALUES " + ", ".join(f"('{i}', '{g}')" for i, g in T.industries()) + ") AS v(industry, industry_group)"
_NUM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Views by name: SQL and the views it needs.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "events_dim": (f"SELECT * FROM {_EVENTS}", ()),
    "groups_dim": (f"SELECT * FROM {_GROUPS}", ()),
    "companies": (
        f"""SELECT c_custkey AS id, lpad(c_custkey::VARCHAR, 6, '0') || CASE WHEN c_custkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS stock_code, c_name AS stock_name,
        CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'unmapped' ELSE {_sql_list(_INDUSTRIES)}[c_custkey % {len(_INDUSTRIES)} + 1] END AS industry,
        CASE WHEN c_custkey % 11 <> 0 THEN floor(c_acctbal)::BIGINT END AS annual_revenue, CASE WHEN c_custkey % 7 <> 0 THEN floor(c_acctbal / 2.0)::BIGINT END AS net_assets,
        c_custkey % 3 = 0 AS is_tracked FROM customer""",
        (),
    ),
    "announcements": (
        f"""SELECT o_orderkey AS id, o_custkey AS company_id, 'ANN-' || o_orderkey AS announcement_id, o_orderpriority || ' notice ' || (o_orderkey % 97) AS title,
        CASE WHEN o_orderkey % 5 <> 0 THEN 'body ' || (o_orderkey % 1000) END AS full_text, o_orderdate::DATE AS published_date,
        {_sql_list(T.STATUSES)}[o_orderkey % 7 + 1] AS processing_status, CASE WHEN o_orderkey % 7 = 6 THEN 'failed before' END AS error_message FROM orders""",
        (),
    ),
    "classifications": (
        f"""SELECT o.o_orderkey AS announcement_id, e.major AS major_category, e.sub AS sub_category, ((o.o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS confidence,
        c.industry, coalesce(g.industry_group, '{T.DEFAULT_GROUP}') AS industry_group FROM orders o
        JOIN events_dim e ON e.sub = {_sql_list(_SUBS)}[o.o_orderkey % {len(_SUBS)} + 1] LEFT JOIN companies c ON c.id = o.o_custkey LEFT JOIN groups_dim g ON g.industry = c.industry WHERE o.o_orderkey % 10 <> 9""",
        ("events_dim", "groups_dim", "companies"),
    ),
    "scores": (
        f"""SELECT *, direction * magnitude * surprise * credibility AS composite_score FROM (SELECT l_orderkey AS announcement_id, l_discount * 20.0::DOUBLE - 1.0::DOUBLE AS direction, l_quantity / 50.0::DOUBLE AS magnitude,
        l_tax * 10.0::DOUBLE AS surprise, 0.9::DOUBLE AS credibility FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) = 1)""",
        (),
    ),
    "eav": (
        f"""SELECT l_orderkey AS announcement_id, fields[l_linenumber % len(fields) + 1] AS field_name,
        CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '15%' WHEN 2 THEN '3,000' WHEN 3 THEN floor(l_extendedprice)::BIGINT::VARCHAR ELSE (l_quantity::BIGINT - 25)::VARCHAR END AS field_value,
        CASE WHEN l_suppkey % 3 = 0 THEN 'text' ELSE 'numeric' END AS field_type, {', '.join(LINE)} FROM lineitem JOIN events_dim e ON e.sub = {_sql_list(_SUBS)}[l_orderkey % {len(_SUBS)} + 1]""",
        ("events_dim",),
    ),
    "last_fields": (
        f"""SELECT announcement_id, field_name, field_value, field_type,
        CASE WHEN regexp_matches(CASE WHEN field_type = 'numeric' THEN replace(field_value, ',', '') ELSE field_value END, '{_NUM}') THEN replace(field_value, ',', '')::DOUBLE END AS v
        FROM eav QUALIFY row_number() OVER (PARTITION BY announcement_id, field_name ORDER BY {', '.join(c + ' DESC' for c in LINE)}) = 1""",
        ("eav",),
    ),
}


def sql(body: str, *views: str) -> str:
    """A statement over the tables, with the named domain views before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for v in VIEWS[name][1]:
            need(v)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][0]})" for v in order)
    body = body.strip()
    if not order:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{ctes},\n{body[len(head) :]}"
    return f"WITH {ctes}\n{body}"
