"""Committed tables: upserts that write a new version of the partitions they touch, and readers that follow an atomic pointer.

A table is a folder of Parquet files and version files:

    data/commit_=<id>/bucket_=<n>/...   the partitions one commit wrote; never changed afterwards
    versions/<number>.json              which commit holds each partition, the schema, and the last batch of each writer

A commit stages the new rows (so they are computed once), rewrites only the buckets of the keys they have, and then publishes a version file
under a name that must not exist yet: it is written beside and renamed. A reader takes the highest version, so it always sees one whole
version; what a failed or interrupted commit has written belongs to no version and is ignored. Of two writers that publish the same number one
succeeds and the other starts again from the new version, at most `attempts` times.

A writer may name its batch (writer, number): the number is kept in the same version file as the data, so a repeated or late batch changes nothing.
The rename must be atomic, as it is in HDFS and local file systems; an object store without that needs a committer of its own.

Rows of null keys are matched like any others (null-safe). Equal keys among the new rows count once, as in the upserts. Column names may be any but
`commit_` and `bucket_`. An upsert of no rows publishes a version only if it creates the table or names a batch. Buckets are a fixed
number a table; choose it so that one bucket is a fair amount of work (Spark deals its rows over tasks by size).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import upsert

COMMIT, BUCKET = "commit_", "bucket_"


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass
class Version:
    number: int = 0
    schema: T.StructType | None = None
    parts: dict[str, str] = field(default_factory=dict)  # bucket: commit
    batches: dict[str, int] = field(default_factory=dict)  # writer: last number

    def text(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema.jsonValue(), "parts": self.parts, "batches": self.batches}, ensure_ascii=False)

    @classmethod
    def of(cls, text: str) -> Version:
        said = json.loads(text)
        return cls(said["number"], T.StructType.fromJson(said["schema"]), said["parts"], said["batches"])


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 16):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    # files

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def _delete(self, folder: str) -> None:
        self._fs().delete(self._path(f"{self.root}/{folder}"), True)

    def _publish(self, version: Version) -> None:
        jvm = self.spark._jvm
        aside, place = (self._path(f"{self.root}/{p}") for p in (f"staged/{uuid.uuid4().hex}.json", f"versions/{version.number:010d}.json"))
        self._fs().mkdirs(place.getParent())
        out = self._fs().create(aside, False)
        out.write(bytearray(version.text().encode()))
        out.close()
        options = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf).rename(aside, place, none)
        except Py4JJavaError as e:
            self._fs().delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(str(place)) from None
            raise

    # reading

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        """A version's content; the current one by default, an empty one before the first commit."""
        if number is None:
            if not (known := self.versions()):
                return Version()
            number = known[-1]
        return Version.of(self.spark.read.text(f"{self.root}/versions/{number:010d}.json", wholetext=True).first()[0])

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of a version, the current one by default. The DataFrame keeps to that version whatever is committed later."""
        version = self.version(number)
        if version.schema is None:
            raise FileNotFoundError(f"no version of a table at {self.root}")
        return self._rows(version, list(version.parts))

    def _rows(self, version: Version, buckets: list[str]) -> DataFrame:
        paths = [f"{self.root}/data/{COMMIT}={version.parts[b]}/{BUCKET}={b}" for b in buckets if b in version.parts]
        if not paths:
            return self.spark.createDataFrame([], version.schema)
        schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in version.schema], T.StructField(COMMIT, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)
        return df.select(*[F.col(f"`{n}`") for n in version.schema.names])

    # writing

    def _bucketed(self, df: DataFrame) -> DataFrame:
        if {COMMIT, BUCKET} & set(df.columns):
            raise ValueError(f"{COMMIT} and {BUCKET} are no column names of a table")
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def commit(self, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None, attempts: int = 3) -> int:
        """Publishes change(old, new) in place of the old rows of all buckets that new has keys of; gives the version's number."""
        if self._done(self.version(), batch):
            return self.version().number
        stage = f"staged/{uuid.uuid4().hex}"
        self._bucketed(new).write.parquet(f"{self.root}/{stage}")
        staged = self.spark.read.schema(self._bucketed(new).schema).parquet(f"{self.root}/{stage}")
        touched = sorted(str(r[0]) for r in staged.select(BUCKET).distinct().collect())
        try:
            for left in range(attempts - 1, -1, -1):
                try:
                    return self._commit(staged.drop(BUCKET), touched, change, batch)
                except Conflict:
                    if not left:
                        raise
        finally:
            self._delete(stage)

    def _done(self, version: Version, batch: tuple[str, int] | None) -> bool:
        return batch is not None and version.batches.get(batch[0], batch[1] - 1) >= batch[1]

    def _commit(self, new: DataFrame, touched: list[str], change: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None) -> int:
        now = self.version()
        if self._done(now, batch) or now.schema is not None and not touched and batch is None:
            return now.number
        parts, schema = dict(now.parts), now.schema or new.schema
        if touched:
            old = self._rows(now, touched) if now.schema is not None else self.spark.createDataFrame([], new.schema)
            out, commit = change(old, new), uuid.uuid4().hex
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
            self._bucketed(out).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{COMMIT}={commit}")
            for b in touched:
                parts.pop(b, None)
            parts |= {n.split("=")[1]: commit for n in self._names(f"data/{COMMIT}={commit}") if n.startswith(f"{BUCKET}=")}
        batches = now.batches | ({batch[0]: batch[1]} if batch else {})
        self._publish(Version(now.number + 1, schema, parts, batches))
        return now.number + 1

    def merge(self, new: DataFrame, keep: tuple[str, ...] = (), order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Known keys take the new non-null values, but for the columns `keep`; other rows are added."""
        return self.commit(new, lambda old, rows: upsert.merge_non_null(old, rows, self.keys, keep, order), batch)

    def replace(self, new: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """New rows replace those of their key as a whole, nulls included."""
        return self.commit(new, lambda old, rows: upsert.replace(old, rows, self.keys, order), batch)

    def add_columns(self, columns: dict[str, str]) -> int:
        """Adds the missing ones of {name: type}, null in all rows, by a version file alone; nothing the second time."""
        now = self.version()
        missing = {n: t for n, t in columns.items() if n not in now.schema.names}
        if not missing:
            return now.number
        more = self.spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in missing.items())).schema
        self._publish(Version(now.number + 1, T.StructType([*now.schema, *more]), now.parts, now.batches))
        return now.number + 1

    def clean(self, keep: int = 1, older_than_seconds: float = 86_400) -> None:
        """Drops all versions but the last `keep`, then the data that no version names and nobody has written lately."""
        known = self.versions()
        for n in known[: max(0, len(known) - max(1, keep))]:
            self._delete(f"versions/{n:010d}.json")
        used = {c for n in self.versions() for c in self.version(n).parts.values()}
        for folder in ("data", "staged"):
            for name in self._names(folder):
                age = time.time() - self._fs().getFileStatus(self._path(f"{self.root}/{folder}/{name}")).getModificationTime() / 1000
                if name.removeprefix(f"{COMMIT}=") not in used and age >= older_than_seconds:
                    self._delete(f"{folder}/{name}")
