"""Extraction results (JSON) to typed entity-attribute-value rows, and the prompts that ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..plans import taxonomy as T

CONFIDENCE = 0.8


def to_fields(results: DataFrame, model: str = "model") -> DataFrame:
    """(announcement_id, sub_category, result) to EAV rows; a result that is no JSON object has none.

    Of a known sub-category only its own fields and the generic ones stay. Numbers and truth values are numeric (a truth
    value as True or False, which reads back as no number), lists are json, everything else is text.
    """
    ev = F.broadcast(T.events_df(results.sparkSession).select(F.col("sub").alias("sub_category"), F.col("fields").alias("_own")))
    parsed = results.join(ev, "sub_category", "left").select("announcement_id", "_own", F.expr("try_parse_json(result)").alias("_v"))
    # an array's elements have no key
    rows = parsed.lateralJoin(results.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key is not null")
    rows = rows.select("announcement_id", "_own", F.col("key").alias("field_name"), "value")
    rows = rows.where(F.col("_own").isNull() | F.array_contains("_own", F.col("field_name")) | F.col("field_name").isin(*T.GENERIC_FIELDS))
    rows = rows.select("announcement_id", "field_name", "value", F.expr("schema_of_variant(value)").alias("_kind"))
    rows = rows.withColumn("_s", F.expr("case when _kind = 'STRING' then cast(value as string) else to_json(value) end"))
    kind = F.col("_kind")
    truth = kind == "BOOLEAN"
    numeric = truth | kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    return rows.select(
        "announcement_id",
        "field_name",
        F.when(kind == "VOID", F.lit(None)).when(truth, F.initcap("_s")).otherwise(F.col("_s")).alias("field_value"),
        F.when(kind == "VOID", "text").when(numeric, "numeric").when(kind.startswith("ARRAY"), "json").otherwise("text").alias("field_type"),
        F.lit(None).cast("string").alias("unit"),
        F.lit(CONFIDENCE).alias("confidence"),
        F.lit(model).alias("model_used"),
    )


def gated(classified: DataFrame, least: float = T.MIN_CONFIDENCE, limit: int | None = None) -> DataFrame:
    """Rows confident enough to extract from. The filter comes before the limit, so low confidence never fills a batch."""
    df = classified.where(F.col("confidence") >= least)
    return df if limit is None else df.orderBy("announcement_id").limit(limit)


def prompt(title: Column, body: Column, sub_label: Column, fields: Column) -> Column:
    """What is asked of the model: the sub-category's fields if it is known, else the generic ones."""
    text = F.coalesce(F.nullif(truncate(body), F.lit("")), F.lit("(no text)"))
    asked = F.when(fields.isNotNull(), F.concat(F.lit("Event: "), sub_label, F.lit("\nFields: "), F.array_join(fields, ", "))).otherwise(
        F.lit("Event: unknown\nFields: " + ", ".join((*T.GENERIC_FIELDS, "amount", "ratio")))
    )
    return F.concat(asked, F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nText: "), text)
