"""Registered queries that write committed tables and read them back: upserts, reports, the incremental fetch and the daily run."""

from __future__ import annotations

import datetime as dt
import functools
import itertools
import json
import re
from collections.abc import Callable, Iterator

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lineage, scoring, search, selection
from ..sources import answers, readers
from ..sources.keywords import KeywordTable
from ..sources.layout import YEAR, Layout, between, buckets_for, small
from ..sources.snapshots import Snapshots
from . import daily
from . import taxonomy as T
from .bridge import Tables
from .catalog_queries import END as END_DAY
from .catalog_queries import START as START_DAY
from .registry import query, query_like


def _announcements(t: Tables) -> DataFrame:
    return t.announcements.select("announcement_id", "title", "full_text", "processing_status")


@query(
    "ups02_committed_upserts",
    """SELECT announcement_id, CASE WHEN id % 15 = 0 THEN 'third' WHEN id % 3 = 0 THEN 'second' ELSE title END AS title, full_text, processing_status FROM announcements
    UNION ALL SELECT announcement_id || '-B', 'third', NULL, 'fetched' FROM announcements WHERE id % 5 = 1""",
    "announcements",
)
def _(t: Tables) -> DataFrame:
    """The table as read back after three upserts, the second of them written twice."""
    a, k = _announcements(t), F.substring("announcement_id", 5, 20).cast("long")
    empty = F.lit(None).cast("string")
    second = a.where(k % 3 == 0).select("announcement_id", F.lit("second").alias("title"), empty.alias("full_text"), F.lit("fetched").alias("processing_status"))
    third = second.where(k % 5 == 0).withColumn("title", F.lit("third")).unionByName(
        a.where(k % 5 == 1).select(F.concat("announcement_id", F.lit("-B")).alias("announcement_id"), F.lit("third").alias("title"), empty.alias("full_text"), F.lit("fetched").alias("processing_status"))
    )
    table = Snapshots(t.spark, lineage.new_folder(t.spark, "announcements"), ["announcement_id"])
    for number, rows in enumerate((a, second, second, third)):
        table.merge(rows, keep=("processing_status",), batch=("upsert", min(number, 1) if number < 3 else 2))
    return table.read()


@query(
    "snk02_stored_reports",
    """SELECT o_orderdate::DATE AS report_date, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS industry_filter, count(*) AS total_announcements,
    CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) > 0 THEN 'again' ELSE 'first' END AS summary_text FROM orders GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """Report rows by date and filter, where no filter is a key like any other; a second write updates what it knows and leaves the rest."""
    key = [F.to_date("o_orderdate").alias("report_date"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("industry_filter")]
    reports = t.raw("orders").groupBy(*key).agg(F.count("*").alias("total_announcements"), F.lit("first").alias("summary_text"))
    again = t.raw("orders").where("o_orderkey % 2 = 0").select(*key).distinct().select("*", F.lit(None).cast("long").alias("total_announcements"), F.lit("again").alias("summary_text"))
    table = Snapshots(t.spark, lineage.new_folder(t.spark, "reports"), ["report_date", "industry_filter"])
    table.merge(reports)
    table.merge(again)
    return table.read()


def _landed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """List items and bodies of orders, one an order."""
    k = F.col("o_orderkey")
    code = F.concat(F.lit("A"), k.cast("string")).alias("art_code")
    items = t.raw("orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("company_code"), F.lit(1).alias("page_index"), k.alias("item_index"), code, F.concat(F.lit("title "), k.cast("string")).alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("notice_date"), F.lit("summary").alias("notice_content"),
    )
    contents = t.raw("orders").where(k % 3 == 0).select(code, F.concat(F.lit("<p>body of "), k.cast("string"), F.lit("</p>")).alias("notice_content"), F.lit("").alias("attach_url_web"), F.lit("u").alias("attach_url"))
    return items, contents


START, HALF, TARGET, LOOKBACK = dt.date(1996, 1, 10), dt.date(1996, 3, 1), dt.date(1996, 6, 30), 5
_FETCHED = f"""(SELECT o_orderkey AS k, 'A' || o_orderkey AS announcement_id, o_custkey AS company_id, o_orderdate::DATE AS published_date,
    CASE WHEN o_orderkey % 3 = 0 THEN 'body of ' || o_orderkey ELSE 'summary' END AS full_text FROM orders
    WHERE o_custkey IN (SELECT id FROM companies WHERE is_tracked) AND o_orderdate::DATE BETWEEN DATE '{START - dt.timedelta(LOOKBACK)}' AND DATE '{TARGET}')"""


class Crash(RuntimeError):
    pass


def _crashing(step: daily.Step, times: int) -> daily.Step:
    """A step that does its work and then fails, so many times: as if the driver were lost before the run noted it."""
    left = [times]

    def run(store: daily.Store, number: int) -> int:
        done = step(store, number)
        if left[0]:
            left[0] -= 1
            raise Crash("lost")
        return done

    return run


@query("ups10_incremental_fetch", f"SELECT announcement_id, company_id, published_date, full_text, 'fetched' AS processing_status FROM {_FETCHED}", "companies")
def _(t: Tables) -> DataFrame:
    """Two fetches of consecutive days, the first one lost after its commit and run again: as one fetch of all days."""
    store = daily.Store(t.spark, lineage.new_folder(t.spark, "store"))
    items, contents = _landed(t)
    for target in (HALF, HALF, TARGET):
        steps = {"fetch": _crashing(daily.fetch_step(items, contents, t.companies, START, target, LOOKBACK), int(target == HALF))}
        daily.run(store, target, steps, ["fetch"])
    return store["announcements"].read().select("announcement_id", "company_id", "published_date", "full_text", "processing_status")


_SUBS = [e.sub for e in T.events()]


@query(
    "ups10_daily_run",
    f"""SELECT announcement_id, full_text, CASE WHEN c >= {T.MIN_CONFIDENCE} AND k % 3 = 0 THEN 'extracted' ELSE 'classified' END AS processing_status, e.major AS major_category, e.sub AS sub_category, c AS confidence,
    CASE WHEN c >= {T.MIN_CONFIDENCE} AND k % 3 = 0 THEN 'v' || k END AS field_value
    FROM (SELECT *, ((k * 7919) % 1000) / 1000.0::DOUBLE AS c FROM {_FETCHED}) f JOIN events_dim e ON e.sub = [{", ".join(f"'{s}'" for s in _SUBS)}][k % {len(_SUBS)} + 1]""",
    "companies", "events_dim",
)
def _(t: Tables) -> DataFrame:
    """Four stages over committed tables; the third is lost after its commit and the fourth before its own, and the run is resumed each time."""
    store = daily.Store(t.spark, lineage.new_folder(t.spark, "store"))
    items, contents = _landed(t)
    k = F.substring("announcement_id", 2, 20).cast("long")

    def predict(rows: DataFrame) -> DataFrame:
        sub = F.get(F.array(*map(F.lit, _SUBS)), (k % len(_SUBS)).cast("int"))
        return rows.select(F.col("id").alias("announcement_id"), sub.alias("sub_category"), (((k * 7919) % 1000) / F.lit(1000.0)).alias("confidence"))

    def answer(rows: DataFrame) -> DataFrame:
        sure = store["classifications"].read().where(F.col("confidence") >= T.MIN_CONFIDENCE).select(F.col("announcement_id").alias("id"))
        rows = rows.where(k % 3 == 0).join(sure, "id", "left_semi")
        return rows.select(F.col("id").alias("announcement_id"), F.lit("amount").alias("field_name"), F.concat(F.lit("v"), k.cast("string")).alias("field_value"), F.lit("text").alias("field_type"))

    steps = {
        "fetch": daily.fetch_step(items, contents, t.companies, START, TARGET, LOOKBACK), "preprocess": daily.preprocess_step,
        "classify": _crashing(daily.classify_step(predict, t.companies), 1), "extract": daily.extract_step(answer),
    }
    while daily.run(store, TARGET, steps, list(steps)).status == "failed":
        pass
    a = store["announcements"].read()
    c = store["classifications"].read().select(F.col("announcement_id").alias("id"), "major_category", "sub_category", "confidence")
    f = store["extracted_fields"].read().select(F.col("announcement_id").alias("id"), "field_value")
    return a.join(c, "id", "left").join(f, "id", "left").select("announcement_id", "full_text", "processing_status", "major_category", "sub_category", "confidence", "field_value")


STATEMENTS = readers.Endpoint("income", "ts_code string, end_date date, report_type string, revenue double", ("ts_code", "report_type"), "end_date")


def _landed_client(folder: str) -> Callable[[str, dict], Iterator[tuple]]:
    """A stand-in for the vendor over a landed table: it gives only what its parameters ask for, as the vendor does.

    The table is read batch by batch, and a code of digits is looked for in the file's columns before rows are made.
    """

    def client(endpoint: str, parameters: dict) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        place, own = fs.FileSystem.from_uri(folder) if "://" in folder else (None, folder)
        table = ds.dataset(f"{own}/orders.parquet", filesystem=place)
        code = re.fullmatch(r"C(0|-?[1-9][0-9]{0,8})", parameters.get("ts_code", ""))
        asked = ds.field("o_custkey") == int(code[1]) if code and pa.types.is_integer(table.schema.field("o_custkey").type) else None
        batches = table.to_batches(columns=["o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"], filter=asked, batch_size=8192, batch_readahead=2, fragment_readahead=1)
        day = lambda v: v.date() if isinstance(v, dt.datetime) else v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v)[:10])
        for r in itertools.chain.from_iterable(b.to_pylist() for b in batches):
            row = (f"C{r['o_custkey']}", day(r["o_orderdate"]), r["o_orderstatus"], float(r["o_totalprice"]))
            said = row[1].strftime("%Y%m%d")
            if parameters.get("ts_code", row[0]) == row[0] and parameters.get("report_type", row[2]) == row[2] and parameters.get("start_date", said) <= said <= parameters.get("end_date", said):
                yield row

    return client


@query(
    "src03_pushed_filters",
    """SELECT 'C' || o_custkey AS ts_code, o_orderdate::DATE AS end_date, o_orderstatus AS report_type, o_totalprice::DOUBLE AS revenue FROM orders
    WHERE o_custkey IN (7, 10, 13) AND o_orderdate::DATE >= DATE '1995-06-01' AND o_orderdate::DATE < DATE '1998-01-01' AND o_orderstatus = 'O' AND o_totalprice > 1000""",
)
def _(t: Tables) -> DataFrame:
    """Codes, dates and kind go to the vendor as parameters; the rest is filtered by Spark."""
    rows = readers.vendor_table(t.spark, _landed_client(t.folder), STATEMENTS, per_minute=60_000)
    rows = rows.where(F.col("ts_code").isin("C7", "C10", "C13") & (F.col("end_date") >= F.lit("1995-06-01").cast("date")) & (F.col("end_date") < F.lit("1998-01-01").cast("date")))
    return rows.where((F.col("report_type") == "O") & (F.col("revenue") > 1000))


@query(
    "ext06_stored_answers",
    """SELECT id, '{"title": "' || title || '"}' AS answer, length(title) AS answer_tokens FROM announcements""",
    "announcements",
)
def _(t: Tables) -> DataFrame:
    """JSON answers to all titles, asked for in two runs that overlap; each distinct title is asked once."""
    store = answers.Answers(t.spark, lineage.new_folder(t.spark, "answers"), "model-1")

    def answer(prompt: str) -> dict:
        return {"text": json.dumps({"title": prompt}), "tokens": len(prompt)}

    asked = store.fill(t.announcements.where("id % 2 = 0"), "title", answers.parsed(answer)) + store.fill(t.announcements, "title", answers.parsed(answer))
    if asked != t.announcements.select("title").distinct().count():
        raise AssertionError(f"{asked} calls are not one a title")
    return store.answered(t.announcements.select("id", "title"), "title", "answer").select("id", "answer", F.col("answer_tokens"))


@query(
    "ext07_completions",
    """SELECT id, CASE WHEN id % 97 % 10 <> 3 THEN 'said: ' || title END AS answer, CASE WHEN id % 97 % 10 = 3 THEN 'ValueError: no answer' END AS answer_error FROM announcements""",
    "announcements",
)
def _(t: Tables) -> DataFrame:
    """Plain completions with a generic retry: the first call of each prompt fails, and some prompts never get an answer."""
    store = answers.Answers(t.spark, lineage.new_folder(t.spark, "answers"), "model-2")
    tries: dict[str, int] = {}

    def answer(prompt: str) -> str:
        tries[prompt] = tries.get(prompt, 0) + 1
        if tries[prompt] == 1 or prompt.endswith("3"):
            raise ValueError("no answer")
        return f"said: {prompt}"

    store.fill(t.announcements, "title", answer, attempts=2, wait=lambda s: None)
    return store.answered(t.announcements.select("id", "title"), "title", "answer").select("id", "answer", "answer_error")


def _layout(t: Tables) -> Layout:
    return Layout(t.spark, lineage.new_folder(t.spark, "layout"), buckets_for(t.raw("lineitem").count()))


@query_like("flt04_laid_range", "flt04_date_range")
def _(t: Tables) -> DataFrame:
    """Days of a laid-out table: only the partitions of their years are read."""
    rows = between(_layout(t).write("announcements", t.announcements, "id", "published_date"), "published_date", START_DAY, END_DAY)
    return rows.where(F.col("processing_status") == "reported").drop(YEAR)


@query_like("jn03_laid_details", "jn03_details")
def _(t: Tables) -> DataFrame:
    """Facts in the same buckets, joined without an exchange."""
    laid = _layout(t)
    facts = laid.write("announcements", t.announcements, "id", "published_date").drop(YEAR)
    return search.details(facts, small(t.companies), laid.write("classifications", t.classifications, "announcement_id"), laid.write("scores", t.scores, "announcement_id"))


@query_like("rul16_laid_composite", "rul16_composite")
def _(t: Tables) -> DataFrame:
    """The rules over laid-out facts and fields: grouping the fields and joining all of it needs no exchange either."""
    laid = _layout(t)
    facts = laid.write("announcements", t.announcements.select("id", "company_id"), "id")
    fields = scoring.field_map(laid.write("fields", t.fields, "announcement_id"), F.col("row_order"), laid_out=True)
    scored = scoring.score(facts, laid.write("classifications", t.classifications, "announcement_id"), small(t.companies), fields)
    return scored.select("announcement_id", (F.round("composite_score", 8) + 0.0).alias("composite_score"))


_KEYWORDS = ("urgent", "1_urg%notice", "TICE 9", "not specified", "5", "no such word", "%")


@query(
    "flt01_indexed_keywords",
    f"""SELECT keyword, a.id, a.announcement_id, a.title, a.published_date FROM announcements a JOIN (VALUES {", ".join(f"('{k}')" for k in _KEYWORDS)}) AS k(keyword) ON a.title ILIKE '%' || keyword || '%'""",
    "announcements",
)
def _(t: Tables) -> DataFrame:
    """All announcements under every keyword that their title holds, by the index of a stored table."""
    rows = t.announcements
    table = KeywordTable(t.spark, lineage.new_folder(t.spark, "keywords"), rows.schema)
    table.add(rows)
    found = [table.search(k).select(F.lit(k).alias("keyword"), "id", "announcement_id", "title", "published_date") for k in _KEYWORDS]
    return functools.reduce(DataFrame.unionByName, found)


@query("ml08_best_model")
def _(t: Tables) -> DataFrame:
    """Every labelled vector with its split and what the best of the trained rounds predicts for it."""
    rows = selection.split_labelled(t.raw("embeddings"), "label", "vec_id").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    trained = selection.Selection(t.spark, lineage.new_folder(t.spark, "training")).fit(rows, label="label_id")
    return trained.model().transform(rows).select("vec_id", "split", "label", F.col("label_id"), F.col("prediction").cast("long").alias("predicted_id"))
