"""What every change job gives back, and how it is put into the store.

A job writes its judged requests to the shared folder before it uses them. They are batch-sized, several outputs read
them, and as files they have a true size: Spark then broadcasts a small batch into a large state table on its own and
leaves the state unshuffled, or shuffles both when the batch is large.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.changes import append, cut_to, order_of
from tallyhouse.plans.lookups import Tables
from tallyhouse.sources.store import CHANGE_MESSAGES, REQUEST_LOG, UPLOADS, Snapshot, TableStore

def request_order() -> Column:
    """Requests of a batch count in this order."""
    return order_of("req_time", "req_id")


@dataclass(frozen=True)
class JobResult:
    """``replaced`` tables get new content, ``appended`` ones only more rows; both leave the old state as it is."""

    name: str
    requests: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    replaced: Mapping[str, DataFrame] = field(default_factory=dict)
    appended: Mapping[str, DataFrame] = field(default_factory=dict)
    # (req_id, value): change messages as JSON text.
    messages: DataFrame | None = None
    # Image ids no table refers to any more.
    discarded: DataFrame | None = None
    # (image_id, content, size): what the accepted requests upload, under the ids the tables hold.
    uploads: DataFrame | None = None

    def table(self, t: Tables, name: str) -> DataFrame:
        """A table as it is after the job."""
        state = self.replaced.get(name, t[name])
        return append(state, self.appended[name]) if name in self.appended else state


def log_rows(result: JobResult) -> DataFrame:
    done = result.accepted.select("req_id", F.lit(None).cast("string").alias("reason"))
    both = done.unionByName(result.rejected)
    return both.select(F.lit(result.name).alias("job"), F.col("req_id").cast("string").alias("req_id"), "reason")


def commit(store: TableStore, base: Snapshot, result: JobResult, source: str = "batch", batch: int | None = None) -> Snapshot:
    """All tables, the request log and the messages of one job in a single commit."""
    appended = dict(result.appended)
    replaced = dict(result.replaced)
    for name in set(appended) & set(replaced):
        replaced[name] = append(replaced[name], appended.pop(name))
    appended[REQUEST_LOG] = log_rows(result)
    if result.messages is not None:
        appended[CHANGE_MESSAGES] = result.messages
    if result.uploads is not None:
        appended[UPLOADS] = result.uploads
    return store.commit(base, replaced, appended, source, batch)


def fresh(requests: DataFrame, log: DataFrame, job: str) -> DataFrame:
    """Requests that this job has not decided before, so a repeated delivery changes nothing.

    The log keeps growing, so it is cut to the ids asked for before it meets the requests.
    """
    asked = requests.withColumn("_asked_id", F.col("req_id").cast("string"))
    seen = cut_to(log.where(F.col("job") == job).select(F.col("req_id").alias("_seen")), "_seen", asked, "_asked_id")
    return asked.join(seen, asked["_asked_id"] == seen["_seen"], "left_anti").drop("_asked_id")
