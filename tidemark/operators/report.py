"""The daily report: its sections as small DataFrames, its summary, and its Markdown as one string row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..plans import taxonomy as T
from .stats import report_totals

TABLE_ROWS = 20
# The texts and formats of the report.
QUIET = "%s 共处理 %d 条公告，无高影响事件。"
LOUD = "%s 共处理 %d 条公告，其中 %d 条高影响事件。 最高评分: %s... (综合: %s)"
HEAD = "# 公告事件驱动分析日报\n**日期**: %s\n\n---\n\n## 一、执行摘要\n\n- **公告总数**: %d\n- **高影响事件**: %d (阈值 |score| ≥ %s)\n- **利好信号**: %d | **利空信号**: %d | **中性**: %d\n"
ROW = "| %s(%s) | %s | %s | %s | %s | %s | %s | %s | **%s** |"
COUNT = "- **%s**: %d 条"
DEEP = "### %d. %s — %s\n\n- **综合评分**: %s\n\n> %s\n"
UNTITLED = "(无标题)"
UNSAID = "*(AI 分析暂不可用)*"
TABLE = "| 股票 | 行业 | 公告标题 | 分类 | 方向 | 强度 | 意外度 | 可信度 | 综合评分 |\n|------|------|---------|------|------|------|--------|--------|----------|\n"
SECTION_TABLE = "## 二、高影响事件\n\n"
NO_TABLE = "*今日无高影响事件*"
SECTION_CATEGORIES = "## 三、分类分布\n\n"
SECTION_GROUPS = "## 四、行业分布\n\n"
SECTION_DEEP = "## 五、深度分析\n\n"


def items(announcements: DataFrame, scores: DataFrame, classifications: DataFrame, companies: DataFrame, report_date=None) -> DataFrame:
    """Scored announcements of a date with what is known of them; rows without a score are dropped."""
    a = announcements.select(F.col("id").alias("announcement_id"), "company_id", "title", "published_date", "processing_status")
    if report_date is not None:
        a = a.where((F.col("published_date") == F.lit(report_date)) & (F.col("processing_status") == "scored"))
    s = scores.select("announcement_id", "direction", "magnitude", "surprise", "credibility", "composite_score")
    c = classifications.select("announcement_id", "major_category", "sub_category", "industry_group")
    co = companies.select(F.col("id").alias("company_id"), "stock_code", "stock_name", "industry")
    return a.join(s, "announcement_id").join(c, "announcement_id", "left").join(co, "company_id", "left")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` rows by strength, numbered from 1: a top-k, then a window over those few rows."""
    top = rows.orderBy(F.desc(F.abs("composite_score")), "announcement_id").limit(most)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.abs("composite_score")), "announcement_id")))


def categories(rows: DataFrame) -> DataFrame:
    """Counts of major-sub, the most frequent first; ties in the order of their strongest item."""
    key = F.concat_ws("-", "major_category", "sub_category")
    first = F.min(F.struct((-F.abs("composite_score")).alias("m"), F.col("announcement_id").alias("i")))
    return rows.where(F.col("sub_category").isNotNull()).groupBy(key.alias("category")).agg(F.count("*").alias("n"), first.alias("_f")).orderBy(F.desc("n"), "_f").drop("_f")


def group_of(group: Column, industry: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), T.resolve_group(industry))


def industry_groups(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct((-F.abs("composite_score")).alias("m"), F.col("announcement_id").alias("i")))
    return rows.groupBy(group_of(F.col("industry_group"), F.col("industry")).alias("industry_group")).agg(F.count("*").alias("n"), first.alias("_f")).orderBy(F.desc("n"), "_f").drop("_f")


def summary(rows: DataFrame, report_date: str, threshold: float = T.HIGH_IMPACT) -> DataFrame:
    """One line: how many items and how many of high impact, with the strongest one's title and score."""
    strong = F.abs("composite_score") >= threshold
    one = rows.agg(
        F.count("*").alias("total"),
        F.count_if(strong).alias("high"),
        F.max_by(F.struct("title", "composite_score"), F.when(strong, F.struct(F.abs("composite_score"), -F.col("announcement_id")))).alias("top"),
    )
    text = F.when(F.col("high") == 0, F.format_string(QUIET, F.lit(report_date), "total")).otherwise(
        F.format_string(LOUD, F.lit(report_date), "total", "high", F.substring(F.coalesce("top.title", F.lit("")), 1, 30), fixed(F.col("top.composite_score"), 3, plus=True))
    )
    return one.select("total", "high", text.alias("summary_text"))


def _lines(df: DataFrame, line: Column, order: list[Column]) -> DataFrame:
    """A small DataFrame's lines in order, as one string row."""
    n = df.withColumn("_n", F.row_number().over(W.orderBy(*order))).select("_n", line.alias("_l"))
    return n.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_l"))), lambda s: s["_l"]), "\n").alias("text"))


def markdown(rows: DataFrame, report_date: str, narratives: DataFrame | None = None, threshold: float = T.HIGH_IMPACT, top: int = T.TOP_N) -> DataFrame:
    """The whole report as one row (text). The distributed part is aggregated first; only bounded tables are turned into lines."""
    strong = rows.where(F.abs("composite_score") >= threshold)
    t = report_totals(rows, threshold)
    head = t.select(
        F.format_string(
            HEAD,
            F.lit(report_date), "total", "high", F.lit(str(threshold)), "bullish", "bearish", "neutral",
        ).alias("text")
    )
    q = lambda c: F.coalesce(F.col(c), F.lit("?"))
    row = F.format_string(
        ROW, q("stock_name"), q("stock_code"), F.coalesce(F.nullif("industry", F.lit("")), F.lit("?")),
        F.substring(F.coalesce("title", F.lit("")), 1, 30), q("sub_category"), fixed(F.col("direction"), 2, plus=True), fixed(F.col("magnitude"), 2), fixed(F.col("surprise"), 2), fixed(F.col("credibility"), 2),
        fixed(F.col("composite_score"), 3, plus=True),
    )
    table = _lines(ranked(strong, TABLE_ROWS), row, [F.col("place")])
    cats = _lines(categories(rows), F.format_string(COUNT, "category", "n"), [F.desc("n"), F.col("category")])
    groups = _lines(industry_groups(rows), F.format_string(COUNT, "industry_group", "n"), [F.desc("n"), F.col("industry_group")])
    deep = ranked(strong, top)
    deep = deep.join(narratives, "announcement_id", "left") if narratives is not None else deep.withColumn("narrative", F.lit(None).cast("string"))
    said = F.format_string(
        DEEP, "place", q("stock_name"), F.coalesce("title", F.lit(UNTITLED)), fixed(F.col("composite_score"), 3, plus=True), F.coalesce("narrative", F.lit(UNSAID))
    )
    deep = _lines(deep, said, [F.col("place")])
    parts = [
        head,
        table.select(F.concat(F.lit(SECTION_TABLE), F.when(F.col("text") == "", NO_TABLE).otherwise(F.concat(F.lit(TABLE), "text")), F.lit("\n")).alias("text")),
        cats.select(F.concat(F.lit(SECTION_CATEGORIES), "text", F.lit("\n")).alias("text")),
        groups.select(F.concat(F.lit(SECTION_GROUPS), "text", F.lit("\n")).alias("text")),
        deep.select(F.when(F.col("text") != "", F.concat(F.lit(SECTION_DEEP), "text")).otherwise("").alias("text")),
    ]
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("i"), "text")
        out = p if out is None else out.unionByName(p)
    return out.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), "\n").alias("text"))


def write_markdown(report: DataFrame, folder: str, report_date: str) -> str:
    """The report's one row as a text file report_<date> in a folder that Spark can write."""
    path = f"{folder}/report_{report_date}"
    report.coalesce(1).write.mode("overwrite").text(path)
    return path
