"""The status machine: each stage is DataFrame to DataFrame over the rows in its own status; all others pass unchanged."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import scoring
from . import taxonomy as T

ORDER = ("fetch", "preprocess", "classify", "extract", "score", "report")


def preprocess(announcements: DataFrame) -> DataFrame:
    """fetched to preprocessed: the cleaned body, or title; the error is reset."""
    now = F.col("processing_status") == "fetched"
    return announcements.withColumns(
        {
            "full_text": F.when(now, text.preprocess(F.col("full_text"), F.col("title"))).otherwise(F.col("full_text")),
            "error_message": F.when(now, F.lit(None)).otherwise(F.col("error_message")),
            "processing_status": F.when(now, "preprocessed").otherwise(F.col("processing_status")),
        }
    )


def classify(announcements: DataFrame, predictions: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """preprocessed to classified wherever there is a prediction (announcement_id, sub_category, confidence); the classifications too."""
    ev = F.broadcast(T.events_df(announcements.sparkSession).select(F.col("sub").alias("sub_category"), F.col("major").alias("_major")))
    co = companies.select(F.col("id").alias("company_id"), "industry")
    p = predictions.join(ev, "sub_category", "left")
    now = announcements.where(F.col("processing_status") == "preprocessed").select(F.col("id").alias("announcement_id"), "company_id").join(p, "announcement_id").join(co, "company_id", "left")
    made = now.select("announcement_id", F.coalesce("_major", F.lit("?")).alias("major_category"), "sub_category", "confidence", "industry", T.resolve_group(F.col("industry")).alias("industry_group"))
    hit = made.select(F.col("announcement_id").alias("id"), F.lit(True).alias("_hit"))
    done = announcements.join(hit, "id", "left")
    return done.withColumn("processing_status", F.when(F.col("_hit"), "classified").otherwise(F.col("processing_status"))).drop("_hit"), made


def extract(announcements: DataFrame, classifications: DataFrame, answered: DataFrame, least: float = T.MIN_CONFIDENCE) -> DataFrame:
    """classified to extracted where the confidence suffices and an answer is there; to failed without a classification."""
    c = classifications.select(F.col("announcement_id").alias("id"), F.col("confidence").alias("_c"))
    a = answered.select(F.col("announcement_id").alias("id"), F.lit(True).alias("_a")).distinct()
    now = F.col("processing_status") == "classified"
    df = announcements.join(c, "id", "left").join(a, "id", "left")
    status = F.when(now & F.col("_c").isNull(), "failed").when(now & (F.col("_c") >= least) & F.col("_a"), "extracted").otherwise(F.col("processing_status"))
    error = F.when(now & F.col("_c").isNull(), "No classification").otherwise(F.col("error_message"))
    return df.withColumns({"error_message": error, "processing_status": status}).drop("_c", "_a")


def score(announcements: DataFrame, classifications: DataFrame, companies: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """extracted to scored or failed; the scores too."""
    scored = scoring.score(announcements.where(F.col("processing_status") == "extracted"), classifications, companies, fields)
    s = scored.select(F.col("announcement_id").alias("id"), F.col("processing_status").alias("_s"), F.col("error_message").alias("_e"))
    df = announcements.join(s, "id", "left")
    df = df.withColumns({"error_message": F.coalesce("_e", "error_message"), "processing_status": F.coalesce("_s", "processing_status")}).drop("_s", "_e")
    return df, scored.where(F.col("error_message").isNull())


def mark_reported(announcements: DataFrame, items: DataFrame) -> DataFrame:
    hit = items.select(F.col("announcement_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    df = announcements.join(hit, "id", "left")
    return df.withColumn("processing_status", F.when(F.col("_hit"), "reported").otherwise(F.col("processing_status"))).drop("_hit")


RUNS = (
    "run_id string, run_type string, status string, started_at timestamp, completed_at timestamp, records_processed long, records_failed long, "
    "error_message string, run_metadata string"
)


@dataclass
class Run:
    """A pipeline run's record; times are UTC."""

    run_type: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    status: str = "running"
    started_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    completed_at: datetime | None = None
    records_processed: int = 0
    records_failed: int = 0
    error_message: str | None = None
    metadata: dict = field(default_factory=dict)

    def row(self, spark: SparkSession) -> DataFrame:
        said = json.dumps(self.metadata, ensure_ascii=False) if self.metadata else None
        return spark.createDataFrame(
            [(self.run_id, self.run_type, self.status, self.started_at, self.completed_at, self.records_processed, self.records_failed, self.error_message, said)], RUNS
        )


def complete_run(runs: DataFrame, run_id: str, at: Column, processed: int = 0, failed: int = 0) -> DataFrame:
    """The stored runs with one of them completed; an unknown id changes nothing."""
    return _updated(runs, run_id, status=F.lit("completed"), completed_at=at, records_processed=F.lit(processed).cast("long"), records_failed=F.lit(failed).cast("long"))


def fail_run(runs: DataFrame, run_id: str, at: Column, error: str) -> DataFrame:
    """The stored runs with one of them failed; its counts stay as they are."""
    return _updated(runs, run_id, status=F.lit("failed"), completed_at=at, error_message=F.lit(error))


def _updated(runs: DataFrame, run_id: str, **values: Column) -> DataFrame:
    own = F.col("run_id") == run_id
    return runs.withColumns({k: F.when(own, v).otherwise(F.col(k)) for k, v in values.items()})


def run(stages: list[str], steps: dict[str, Callable[[], tuple[int, int]]]) -> Run:
    """Runs stages in order; each step gives (processed, failed). Row failures count, a stage's own failure ends the run; unknown stages are skipped."""
    made = Run("full" if len(stages) >= 4 else stages[0] if stages else "full", metadata={"stages": stages})
    for stage in stages:
        if stage not in steps:
            continue
        try:
            done, failed = steps[stage]()
        except Exception as e:
            made.status, made.error_message, made.completed_at = "failed", f"{stage}: {e}", datetime.now(UTC)
            return made
        made.records_processed += done
        made.records_failed += failed
    made.status, made.completed_at = "completed", datetime.now(UTC)
    return made
