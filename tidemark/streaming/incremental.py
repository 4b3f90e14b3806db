"""The incremental form of the batch stages: what is new is picked up once, and each micro-batch runs the same stage functions.

Two feeds: files that arrive in a folder, and days of an interface (offsets are days; each batch looks some days back, as late rows are
listed under earlier days). A stage writes by batch number (`Snapshots` keeps the last one beside the data), so that a batch that Spark repeats after
a crash changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery


def run_available(spark: SparkSession, source: str, schema: str, checkpoint: str, stage: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Feeds the Parquet files that arrived since the last call to `stage(batch, batch_id)`, and stops.

    The checkpoint folder remembers what was read, so a restart repeats at most the batch that failed; a stage should write by
    batch id, or upsert, to make that harmless.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Days(DataSource):
    """One row a day to be fetched. Options: start (the first day), target (the last one), lookback (days read again before each batch)."""

    @classmethod
    def name(cls) -> str:
        return "days"

    def schema(self) -> str:
        return "day date"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DayReader(dict(self.options))


class DayReader(DataSourceStreamReader):
    """An offset is the next day to read. A target before it gives no days, and later runs go on from there (upserts make the repeated days harmless)."""

    def __init__(self, options: dict):
        self.start, self.target = (dt.date.fromisoformat(options[k]) for k in ("start", "target"))
        self.lookback = int(options.get("lookback", 0))

    def initialOffset(self) -> dict:
        return {"next": self.start.isoformat()}

    def latestOffset(self) -> dict:
        return {"next": max(self.start, self.target + dt.timedelta(1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((start["next"], end["next"]))] if start["next"] < end["next"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, end = (dt.date.fromisoformat(d) for d in partition.value)
        first -= dt.timedelta(self.lookback)
        yield from ((first + dt.timedelta(i),) for i in range((end - first).days))


def run_days(spark: SparkSession, start: dt.date, target: dt.date, lookback: int, checkpoint: str, stage: Callable[[dt.date, dt.date, int], None]) -> None:
    """Calls stage(first day, last day, batch number) for the days up to `target` that no finished batch has covered, `lookback` days before them included.

    The checkpoint folder remembers the days; after a crash the unfinished batch comes again with its own days and number.
    """
    spark.dataSource.register(Days)

    def each(batch: DataFrame, number: int) -> None:
        first, last = batch.agg(F.min("day"), F.max("day")).first()
        if first is not None:
            stage(first, last, number)

    options = {"start": start.isoformat(), "target": target.isoformat(), "lookback": str(lookback)}
    stream = spark.readStream.format("days").options(**options).load()
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
