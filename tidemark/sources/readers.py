"""Sources and sinks: landed tables, JSON lines, payloads of list pages, and call-outs behind small interfaces."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import pickle
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import dates, text

PAGE_SIZE = 50
PAGE = (
    "data struct<page_index:int,page_size:int,total_page:int,total_hits:int,"
    "list:array<struct<art_code:string,title:string,notice_date:string,notice_content:string>>>"
)
LABELLED = "announcement_id string, text string, sub_category string, major_category string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Labelled rows of JSON lines; blank and corrupt lines are skipped, the major category defaults to the first character."""
    df = spark.read.schema(LABELLED).option("mode", "DROPMALFORMED").json(paths)
    return df.withColumn("major_category", F.coalesce(F.nullif("major_category", F.lit("")), F.substring("sub_category", 1, 1)))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def total_pages(total_page: Column, total_hits: Column, size: int = PAGE_SIZE) -> Column:
    """How many list pages there are: as told, or from the hits; at least the first."""
    return F.greatest(F.coalesce(F.nullif(total_page, F.lit(0)), F.ceil(total_hits / F.lit(size)).cast("int"), F.lit(0)), F.lit(1))


def list_items(pages: DataFrame, most: int = 20) -> DataFrame:
    """(company_code, page_index, payload) JSON rows to items in order; pages beyond the last, or after an empty one, are not read."""
    p = pages.select("company_code", F.col("page_index").alias("_page"), F.from_json("payload", PAGE).alias("p"))
    p = p.select("company_code", "_page", F.col("p.data.total_page").alias("_tp"), F.col("p.data.total_hits").alias("_th"), F.col("p.data.list").alias("_l"))
    first_empty = p.where(F.coalesce(F.size("_l"), F.lit(0)) <= 0).groupBy("company_code").agg(F.min("_page").alias("_stop"))
    known = p.groupBy("company_code").agg(F.max(total_pages(F.col("_tp"), F.col("_th"))).alias("_n"))
    p = p.join(first_empty, "company_code", "left").join(known, "company_code")
    p = p.where((F.col("_page") <= F.least("_n", F.lit(most))) & (F.col("_stop").isNull() | (F.col("_page") < F.col("_stop"))))
    return p.select("company_code", "_page", F.posexplode("_l").alias("_i", "item")).select("company_code", F.col("_page").alias("page_index"), F.col("_i").alias("item_index"), "item.*")


def announcements_from(items: DataFrame, contents: DataFrame, companies: DataFrame, target_date, lookback: int = 3, most_companies: int = 0) -> DataFrame:
    """The fetch step over landed tables: tracked companies, the date window, one row an art_code (the first company and item win), bodies joined.

    `contents` has (art_code, notice_content, attach_url_web, attach_url); the cleaned body, else the list's summary, is the text.
    """
    co = companies.where("is_tracked").select(F.col("id").alias("company_id"), text.short_code(F.col("stock_code")).alias("company_code"))
    if most_companies:
        co = co.orderBy("company_id").limit(most_companies)
    it = items.where(F.col("art_code") != "").join(co, "company_code")
    day = F.coalesce(dates.parse_any(F.col("notice_date")), F.lit(target_date))
    it = it.withColumn("published_date", day).where(F.col("published_date").between(F.date_sub(F.lit(target_date), lookback), F.lit(target_date)))
    rest = ["company_id", "title", "published_date", "notice_content"]
    it = it.groupBy("art_code").agg(F.min_by(F.struct(*rest), F.struct("company_id", "page_index", "item_index")).alias("r")).select("art_code", "r.*")
    body = contents.select("art_code", F.col("notice_content").alias("_body"), F.coalesce(F.nullif("attach_url_web", F.lit("")), "attach_url").alias("pdf_url"))
    it = it.join(body, "art_code", "left")
    full = F.coalesce(F.nullif(text.clean_text(F.col("_body")), F.lit("")), F.nullif("notice_content", F.lit("")))
    return it.select(F.col("art_code").alias("announcement_id"), "company_id", "title", full.alias("full_text"), "pdf_url", "published_date", F.lit("fetched").alias("processing_status"))


def latest_financials(income: DataFrame, balance: DataFrame) -> DataFrame:
    """Each company's newest revenue, profit and net assets by period end."""
    i = income.groupBy("ts_code").agg(F.max_by(F.struct("revenue", "n_income"), "end_date").alias("i"))
    b = balance.groupBy("ts_code").agg(F.max_by("net_assets", "end_date").alias("net_assets"))
    return i.join(b, "ts_code", "left").select("ts_code", F.col("i.revenue").alias("annual_revenue"), F.col("i.n_income").alias("net_profit"), "net_assets")


def seed_companies(stocks: DataFrame, pilot: list[str]) -> DataFrame:
    """Companies from a stock list; tracked are those whose industry contains one of the pilot words."""
    tracked = F.exists(F.array(*map(F.lit, pilot)), lambda w: F.contains("industry", w)) if pilot else F.lit(False)
    return stocks.select(
        F.col("ts_code").alias("stock_code"), F.col("name").alias("stock_name"), F.when(F.col("ts_code").endswith(".SH"), "SSE").otherwise("SZSE").alias("exchange"), "industry", F.coalesce(tracked, F.lit(False)).alias("is_tracked")
    )


def with_retry(call: Callable[[], object], attempts: int = 3, wait: Callable[[float], None] = time.sleep, on: tuple[type[Exception], ...] = (Exception,)) -> object:
    """The call's result; failures are repeated after 1, 2, 4... seconds, the last one is raised."""
    for i in range(attempts):
        try:
            return call()
        except on:
            if i + 1 == attempts:
                raise
            wait(2**i)
    return {}


class RateLimit:
    """Keeps calls apart by a minute's share each; retries wait for it as well."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep):
        self.least, self.clock, self.wait, self.last = 60.0 / per_minute, clock, wait, None

    def __call__(self) -> None:
        if self.last is not None and (left := self.least - (self.clock() - self.last)) > 0:
            self.wait(left)
        self.last = self.clock()


def page_request(stock_code: Column, page_index: Column, start: Column | None = None, end: Column | None = None, size: int = PAGE_SIZE) -> Column:
    """A list page's request: exchange suffixes go; an empty code or date sends no parameter (null)."""
    bare = F.replace(F.replace(stock_code, F.lit(".SH"), F.lit("")), F.lit(".SZ"), F.lit(""))
    said = lambda c: F.nullif(c, F.lit("")) if c is not None else F.lit(None).cast("string")
    return F.struct(
        F.lit(size).alias("page_size"), page_index.cast("int").alias("page_index"), F.lit("A").alias("ann_type"), said(bare).alias("stock_list"), said(start).alias("begin_time"), said(end).alias("end_time")
    )


class ListPages:
    """A list interface and its bodies behind a client: (endpoint, parameters) to parsed JSON. An error is an empty page, or an empty body."""

    def __init__(self, client: Callable[[str, dict], dict], limit: Callable[[], None], most: int = 20):
        self.client, self.limit, self.most = client, limit, most

    def _ask(self, endpoint: str, parameters: dict) -> dict:
        self.limit()
        try:
            return self.client(endpoint, parameters) or {}
        except Exception:  # whatever the client raises: the next company goes on
            return {}

    def pages(self, request: dict) -> Iterator[tuple[int, str]]:
        """(page_index, payload) until an empty page, the last page told, or `most`."""
        for index in range(1, self.most + 1):
            page = self._ask("list", {k: v for k, v in (request | {"page_index": index}).items() if v is not None})
            data = page.get("data") if isinstance(page.get("data"), dict) else {}
            if not data.get("list"):
                return
            yield index, json.dumps(page, ensure_ascii=False)
            if index >= (data.get("total_page") or -(-(data.get("total_hits") or 0) // (request.get("page_size") or PAGE_SIZE))):
                return

    def content(self, art_code: str) -> dict:
        return self._ask("content", {"art_code": art_code, "client_source": "web", "page_index": 1}).get("data") or {}


def fetch_pages(requests: DataFrame, client: Callable[[str, dict], dict], per_minute: float = 30, most: int = 20) -> DataFrame:
    """(company_code, page_index, payload) of (company_code, request) rows, read by one task so that the rate limit holds. Write it before using it twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = ListPages(client, RateLimit(per_minute), most)
        for batch in batches:
            for code, request in zip(batch["company_code"], batch["request"], strict=True):
                for index, payload in source.pages(dict(request)):
                    yield pd.DataFrame({"company_code": [code], "page_index": [index], "payload": [payload]})

    return requests.select("company_code", "request").repartition(1).mapInPandas(run, "company_code string, page_index long, payload string")


def fetch_contents(art_codes: DataFrame, client: Callable[[str, dict], dict], per_minute: float = 30) -> DataFrame:
    """(art_code, notice_content, attach_url_web, attach_url) of each art_code, as `announcements_from` reads it; nulls after an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = ListPages(client, RateLimit(per_minute))
        for batch in batches:
            for code in batch["art_code"]:
                said = source.content(code)
                yield pd.DataFrame({"art_code": [code]} | {k: pd.Series([said.get(k)], dtype=object) for k in ("notice_content", "attach_url_web", "attach_url")})

    return art_codes.select("art_code").distinct().repartition(1).mapInPandas(run, "art_code string, notice_content string, attach_url_web string, attach_url string")


def vendor_source(client: Callable[[str, dict], Iterable[tuple]], schema: str = "ts_code string, value string", per_minute: float = 200) -> type[DataSource]:
    """A vendor interface as a Spark data source named "vendor", read by one task so that its rate limit holds.

    `client` (endpoint, parameters) gives tuples in the schema's order; the options endpoint and parameters (JSON) are handed to it.
    Register the class with spark.dataSource.register, and write what is read before using it twice.
    """

    class VendorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "vendor"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return VendorReader(dict(self.options), client, per_minute)

    return VendorSource


#: Bytes of one answer that a task holds in memory.
SPOOL = 8 << 20


def spooled(rows: Iterable[tuple]) -> IO[bytes]:
    """A whole answer, in a file of the task beyond SPOOL bytes: a call that breaks off gives nothing, however long its answer is."""
    kept, rows = tempfile.SpooledTemporaryFile(max_size=SPOOL), iter(rows)  # noqa: SIM115
    try:
        while part := list(itertools.islice(rows, 1000)):
            pickle.dump(part, kept)
    except BaseException:
        kept.close()
        raise
    kept.seek(0)
    return kept


def told(kept: IO[bytes]) -> Iterator[tuple]:
    with kept:
        while True:
            try:
                part = pickle.load(kept)
            except EOFError:
                return
            yield from part


class VendorReader(DataSourceReader):
    def __init__(self, options: dict, client: Callable[[str, dict], Iterable[tuple]], per_minute: float):
        self.options, self.client, self.per_minute = options, client, per_minute

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        parameters, limit = json.loads(self.options.get("parameters", "{}")), RateLimit(self.per_minute)

        def call() -> IO[bytes]:
            limit()
            return spooled(self.client(self.options.get("endpoint", ""), parameters))

        yield from told(with_retry(call))


@dataclass(frozen=True)
class Endpoint:
    """What a vendor endpoint gives and which parameters it takes: `equal` are columns of one value, `dates` the column that start_date and end_date bound."""

    name: str
    schema: str
    equal: tuple[str, ...] = ("ts_code",)
    dates: str | None = None


def _said(value: object) -> str:
    return value.strftime("%Y%m%d") if isinstance(value, dt.date) else str(value)


class PushingReader(VendorReader):
    """Sends what Spark filters by as the endpoint's parameters, if it has one for it; Spark filters what comes all the same.

    An empty text is no parameter, as the vendor takes it for no filter. A list of values of one column is one call a value; of several
    bounds the narrowest is sent.
    """

    def __init__(self, options: dict, client: Callable[[str, dict], Iterable[tuple]], per_minute: float, endpoint: Endpoint):
        super().__init__(options | {"endpoint": endpoint.name}, client, per_minute)
        self.endpoint, self.parameters, self.several = endpoint, json.loads(options.get("parameters", "{}")), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in self.endpoint.equal and isinstance(f, EqualTo) and f.value not in (None, ""):
                self.parameters.setdefault(column, _said(f.value))
            elif column in self.endpoint.equal and isinstance(f, In) and not self.several and f.value and not {None, ""} & set(f.value):
                self.several = (column, [_said(v) for v in dict.fromkeys(f.value)])
            elif column == self.endpoint.dates and column is not None:
                self._bound(f)
            yield f

    def _bound(self, f: Filter) -> None:
        whole = isinstance(getattr(f, "value", None), dt.date) and not isinstance(f.value, dt.datetime)
        if not whole and not isinstance(getattr(f, "value", None), str) or f.value == "":
            return
        step = lambda n: f.value + dt.timedelta(n) if whole else f.value
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            start = _said(step(int(isinstance(f, GreaterThan))))
            self.parameters["start_date"] = max(start, self.parameters.get("start_date", start))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            end = _said(step(-int(isinstance(f, LessThan))))
            self.parameters["end_date"] = min(end, self.parameters.get("end_date", end))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        limit = RateLimit(self.per_minute)

        def call(parameters: dict) -> IO[bytes]:
            limit()
            return spooled(self.client(self.endpoint.name, parameters))

        column, values = self.several or (None, [None])
        for value in values:
            if column in self.parameters and value is not None and value != self.parameters[column]:
                continue  # it equals one value and is one of others
            asked = self.parameters | ({column: value} if column else {})
            yield from told(with_retry(lambda asked=asked: call(asked)))


def vendor_table(spark: SparkSession, client: Callable[[str, dict], Iterable[tuple]], endpoint: Endpoint, per_minute: float = 200, **parameters: object) -> DataFrame:
    """An endpoint as a lazy table whose filters become the vendor's parameters; `parameters` that are not empty are sent besides.

    It is read by one task, so that the rate limit holds, each time it is used: write what is read before using it twice.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class Pushing(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"vendor_{endpoint.name}"

        def schema(self) -> str:
            return endpoint.schema

        def reader(self, schema) -> DataSourceReader:
            return PushingReader(dict(self.options), client, per_minute, endpoint)

    spark.dataSource.register(Pushing)
    sent = {k: _said(v) for k, v in parameters.items() if v not in (None, "")}
    return spark.read.format(Pushing.name()).option("parameters", json.dumps(sent)).load()


def call_out(df: DataFrame, column: str, out: str, answer: Callable[[list[str]], list[str | None]], batch: int = 16) -> DataFrame:
    """A model's answers to a text column, in order and in batches. Write the result before using it twice: a model is called once a row."""

    @F.pandas_udf("string")
    def ask(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            texts = s.fillna("").tolist()
            yield pd.Series([a for i in range(0, len(texts), batch) for a in answer(texts[i : i + batch])], dtype=object)

    return df.withColumn(out, ask(column))


def vendor_rows(table: DataFrame, **equal: object) -> DataFrame:
    """A landed vendor table with optional filters; empty and missing values filter nothing. start_date and end_date bound `end_date`."""
    for name, value in equal.items():
        if value in (None, ""):
            continue
        if name == "start_date":
            table = table.where(F.col("end_date") >= F.lit(value))
        elif name == "end_date":
            table = table.where(F.col("end_date") <= F.lit(value))
        else:
            table = table.where(F.col(name) == F.lit(value))
    return table
