"""Versioned table state on plain Parquet.

Every table is a list of Parquet folders. A commit is one appended row naming the folders of every table; readers take
the newest commit and keep it for the whole job, so several tables change together or not at all. Appends add a folder
and never rewrite what is there. Of two writers that start from one commit the second fails; a table format with ``MERGE INTO`` replaces all of this
(see ``merge_rows``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.changes import order_of
from tallyhouse.schema import TABLES

_COMMIT = T.StructType(
    [
        T.StructField("commit", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("folders", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)

# Outcome of every request ever applied; streams skip what is already here.
REQUEST_LOG = "request_log"
LOG_SCHEMA = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("req_id", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
CHANGE_MESSAGES = "change_messages"
MESSAGE_SCHEMA = T.StructType([T.StructField("req_id", T.StringType()), T.StructField("value", T.StringType())])

# Bytes of uploaded images under the ids that the tables hold.
UPLOADS = "uploads"
UPLOAD_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("size", T.LongType()),
    ]
)

SCHEMAS = {**TABLES, REQUEST_LOG: LOG_SCHEMA, CHANGE_MESSAGES: MESSAGE_SCHEMA, UPLOADS: UPLOAD_SCHEMA}


class StaleSnapshot(RuntimeError):
    """Another writer has committed since the snapshot was taken."""


class Snapshot(Mapping[str, DataFrame]):
    """The tables of one commit."""

    def __init__(self, spark: SparkSession, commit: int, folders: dict[str, list[str]]) -> None:
        self._spark = spark
        self.commit = commit
        self.folders = folders

    def __getitem__(self, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        folders = self.folders.get(name)
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*folders)

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self._root = root.rstrip("/")

    @property
    def _commits(self) -> str:
        return f"{self._root}/_commits"

    def _has_commits(self) -> bool:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._commits)
        return path.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(path)

    def snapshot(self) -> Snapshot:
        if not self._has_commits():
            return Snapshot(self._spark, 0, {})
        # One row per commit; only the newest one reaches the driver.
        log = self._spark.read.schema(_COMMIT).json(self._commits)
        row = log.agg(F.max("commit").alias("commit"), F.max_by("folders", "commit").alias("folders")).first()
        if row["commit"] is None:
            return Snapshot(self._spark, 0, {})
        return Snapshot(self._spark, row["commit"], {k: list(v) for k, v in row["folders"].items()})

    def has_batch(self, source: str, batch: int) -> bool:
        """Whether a stream's micro-batch has been committed before."""
        if not self._has_commits():
            return False
        log = self._spark.read.schema(_COMMIT).json(self._commits)
        return not log.where((F.col("source") == source) & (F.col("batch") == batch)).isEmpty()

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{self._root}/{name}/v={uuid.uuid4().hex}"
        schema = SCHEMAS[name]
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(folder)
        return folder

    def commit(
        self,
        base: Snapshot,
        replaced: Mapping[str, DataFrame] | None = None,
        appended: Mapping[str, DataFrame] | None = None,
        source: str = "batch",
        batch: int | None = None,
    ) -> Snapshot:
        """Writes the new folders, then makes them visible with one row.

        Raises ``StaleSnapshot`` when ``base`` is no longer the newest commit; nothing becomes visible then.
        """
        folders = {k: list(v) for k, v in base.folders.items()}
        for name, df in (replaced or {}).items():
            folders[name] = [self._write(name, df)]
        for name, df in (appended or {}).items():
            folders[name] = [*folders.get(name, []), self._write(name, df)]
        number = base.commit + 1
        self._claim(number, {"commit": number, "source": source, "batch": batch, "folders": folders})
        return Snapshot(self._spark, number, folders)

    def _claim(self, number: int, row: Mapping[str, object]) -> None:
        """Creates the commit's file, which only one writer can: the number is its name."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._commits}/{number:012d}.json")
        files = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        try:
            out = files.create(path, False)
        except Py4JJavaError as failure:
            raise StaleSnapshot(f"commit {number} is taken: another writer was first") from failure
        try:
            out.write(json.dumps(row).encode())
        finally:
            out.close()

    def compact(self, base: Snapshot, *names: str) -> Snapshot:
        """Rewrites tables that many appends have split into one folder."""
        return self.commit(base, replaced={name: base[name] for name in names})


def partition_by_day(df: DataFrame, epoch: str, path: str, tz: str) -> None:
    """Writes a ledger or activity table in day folders, so time filters on ``day`` skip whole folders.

    The sort-free repartition on (day, spread) keeps one hot day from landing in one task.
    """
    from tallyhouse.functions.days import local_date

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(width))
    with_day = df.withColumn("day", local_date(F.col(epoch), tz))
    with_day.repartition("day", spread).write.partitionBy("day").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A catalog table hashed and sorted by ``key``: joins of such tables on their keys need no shuffle at all."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


def merge_rows(target: str, rows: DataFrame, key: str, order: str | None = None) -> None:
    """Upsert into a table whose format supports ``MERGE INTO``; the last row per key counts."""
    fresh = rows
    if order is not None:
        others = [c for c in rows.columns if c != key]
        packed = F.max_by(F.struct(*others), order_of(order)).alias("_last")
        fresh = rows.groupBy(key).agg(packed).select(key, "_last.*")
    on = F.expr(f"{target}.{key} = fresh.{key}")
    fresh.alias("fresh").mergeInto(target, on).whenMatched().updateAll().whenNotMatched().insertAll().merge()
