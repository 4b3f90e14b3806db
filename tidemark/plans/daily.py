"""The daily run over committed tables: stages in order, each committed by the run's number, so that a run that broke off goes on where it stopped.

A run is a row of the table `runs`; its metadata lists the stages it is to do and those it has done. Calling `run` again for the same day and
stages resumes the last run if that did not complete. A stage that had committed when the run broke off, but was not noted, is repeated under the same
number, which the tables know and ignore (its rows then count as processed by nobody). Row failures are statuses; a stage's own failure ends the run.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report, scoring
from ..operators.lineage import cut
from ..sources import readers
from ..sources.answers import Answers
from ..sources.models import narrative_prompt
from ..sources.snapshots import Snapshots
from ..streaming import incremental
from . import stages as S
from . import taxonomy as T

KEYS = {"announcements": ["announcement_id"], "classifications": ["announcement_id"], "extracted_fields": ["announcement_id", "field_name"], "scores": ["announcement_id"], "daily_reports": ["report_date", "industry_filter"], "runs": ["run_id"]}


class Store:
    """The committed tables of one folder. Announcements have an id that follows from their announcement_id."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root = spark, root
        self.tables = {name: Snapshots(spark, f"{root}/{name}", keys, 1 if name == "runs" else buckets) for name, keys in KEYS.items()}

    def __getitem__(self, name: str) -> Snapshots:
        return self.tables[name]

    def in_status(self, status: str) -> DataFrame:
        return self["announcements"].read().where(F.col("processing_status") == status)

    def moved(self, stage: str, number: int, before: str, after: DataFrame) -> int:
        """Commits the announcements whose status is no longer `before`; how many they are."""
        changed = cut(after.where(F.col("processing_status") != before))
        self["announcements"].replace(changed, batch=(stage, number))
        return changed.count()


Step = Callable[[Store, int], int]


def announcements_of(rows: DataFrame) -> DataFrame:
    """Fetched rows with their id and an empty error."""
    return rows.withColumns({"id": F.xxhash64("announcement_id"), "error_message": F.lit(None).cast("string")})


def fetch_step(items: DataFrame, contents: DataFrame, companies: DataFrame, start: dt.date, target: dt.date, lookback: int = 3) -> Step:
    """All days up to the target that earlier runs have not covered, and `lookback` days before; known rows keep their status. Counts new rows."""

    def step(store: Store, number: int) -> int:
        table = store["announcements"]
        before = table.read().count() if table.versions() else 0

        def day_range(first: dt.date, last: dt.date, batch: int) -> None:
            rows = readers.announcements_from(items, contents, companies, last, (last - first).days)
            table.merge(announcements_of(rows), keep=("processing_status", "error_message"), batch=("fetch", batch))

        incremental.run_days(store.spark, start, target, lookback, f"{store.root}/fetched", day_range)
        return table.read().count() - before

    return step


def preprocess_step(store: Store, number: int) -> int:
    return store.moved("preprocess", number, "fetched", S.preprocess(store.in_status("fetched")))


def classify_step(predict: Callable[[DataFrame], DataFrame], companies: DataFrame) -> Step:
    """`predict` gives (announcement_id: the row's id, sub_category, confidence) of preprocessed rows; it is called once a run."""

    def step(store: Store, number: int) -> int:
        rows = store.in_status("preprocessed")
        after, made = S.classify(rows, cut(predict(rows)), companies)
        store["classifications"].replace(made, batch=("classify", number))
        return store.moved("classify", number, "preprocessed", after)

    return step


def extract_step(answer: Callable[[DataFrame], DataFrame]) -> Step:
    """`answer` gives (announcement_id: the row's id, field_name, field_value, field_type) of classified rows; it is called once a run."""

    def step(store: Store, number: int) -> int:
        rows = store.in_status("classified")
        fields = cut(answer(rows))
        store["extracted_fields"].replace(fields, batch=("extract", number))
        after = S.extract(rows, store["classifications"].read(), fields)
        return store.moved("extract", number, "classified", after)

    return step


def score_step(companies: DataFrame) -> Step:
    def step(store: Store, number: int) -> int:
        fields = scoring.field_map(store["extracted_fields"].read(), F.col("field_name"))
        after, made = S.score(store.in_status("extracted"), store["classifications"].read(), companies, fields)
        store["scores"].replace(made, batch=("score", number))
        return store.moved("score", number, "extracted", after)

    return step


def report_step(companies: DataFrame, target: dt.date, answers: Answers | None = None, answer: Callable[[str], str | dict] | None = None) -> Step:
    """The day's report; its rows are reported. With a model, its strongest items get a narrative, asked for once and kept in `answers`."""

    def step(store: Store, number: int) -> int:
        rows = cut(report.items(store["announcements"].read(), store["scores"].read(), store["classifications"].read(), companies, target))
        day = F.lit(target).alias("report_date")
        totals = report.summary(rows, target.isoformat()).select(F.col("summary_text"), F.col("total").cast("long").alias("total_announcements"), F.col("high").cast("long").alias("high_impact_count"))
        said = None
        if answers is not None and answer is not None:
            top = report.ranked(rows.where(F.abs("composite_score") >= T.HIGH_IMPACT), T.TOP_N).select("announcement_id", narrative_prompt().alias("prompt"))
            answers.fill(top, "prompt", answer)
            said = answers.answered(top, "prompt", "narrative").select("announcement_id", "narrative")
        made = report.markdown(rows, target.isoformat(), said).crossJoin(totals)  # one row each
        made = made.select(day, F.lit(None).cast("string").alias("industry_filter"), F.col("text").alias("report_content"), "summary_text", "high_impact_count", "total_announcements")
        store["daily_reports"].merge(made, batch=("report", number))
        store.moved("report", number, "scored", S.mark_reported(store.in_status("scored"), rows))
        return 1

    return step


def _opened(store: Store, target: dt.date, wanted: list[str]) -> S.Run:
    """The last run of the same day and stages if it did not complete, else a new one."""
    rows = store["runs"].read() if store["runs"].versions() else None
    last = None
    if rows is not None:
        number = F.get_json_object("run_metadata", "$.number").cast("long")
        same = (F.get_json_object("run_metadata", "$.target_date") == target.isoformat()) & (F.get_json_object("run_metadata", "$.stages") == json.dumps(wanted, separators=(",", ":")))
        last, highest = rows.agg(F.max_by(F.when(same, F.struct(*rows.columns)), F.when(same, number)), F.max(number)).first()
        if last is not None and last["status"] != "completed":
            return S.Run(last["run_type"], last["run_id"], "running", last["started_at"], None, last["records_processed"], last["records_failed"], None, json.loads(last["run_metadata"]))
    number = 1 + (highest if rows is not None and highest is not None else 0)
    return S.Run("full" if len(wanted) >= 4 else wanted[0] if wanted else "full", metadata={"number": number, "target_date": target.isoformat(), "stages": wanted, "done": []})


def run(store: Store, target: dt.date, steps: dict[str, Step], stages: Iterable[str] = S.ORDER) -> S.Run:
    """Runs or resumes the stages of a day; unknown stages are skipped."""
    made = _opened(store, target, list(stages))
    save = lambda: store["runs"].replace(made.row(store.spark))
    save()
    for stage in made.metadata["stages"]:
        if stage not in steps or stage in made.metadata["done"]:
            continue
        try:
            made.records_processed += steps[stage](store, made.metadata["number"])
        except Exception as e:
            made.status, made.error_message, made.completed_at = "failed", f"{stage}: {e}", dt.datetime.now(dt.UTC)
            save()
            return made
        made.metadata["done"].append(stage)
        save()
    made.status, made.completed_at = "completed", dt.datetime.now(dt.UTC)
    save()
    return made
