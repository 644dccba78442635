"""Applying request streams to the stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhouse.operators.scratch import written
from tallyhouse.plans.jobs import JobResult, commit, fresh
from tallyhouse.sources.store import REQUEST_LOG, TableStore

OTHER_REQUEST = "another request has this id"


def one_per_id(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The request that counts for each ``req_id``, and (req_id, reason) for every different one with the same id.

    Deliveries of one request are one request. Of different ones the earliest counts, of those at one time the first by its
    columns, so it does not matter how they arrive.
    """
    different = requests.distinct()
    rest = [name for name in requests.columns if name not in ("req_id", "req_time")]
    order = F.struct(*[name for name in ("req_time", *rest) if name in requests.columns])
    chosen = different.groupBy("req_id").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    others = chosen.where("_n > 1").select(
        F.explode(F.array_repeat("req_id", (F.col("_n") - 1).cast("int"))).alias("req_id"), F.lit(OTHER_REQUEST).alias("reason")
    )
    return chosen.select("req_id", "_first.*").select(*requests.columns), others


def apply_requests(store: TableStore, requests: DataFrame, job: Callable[..., JobResult], source: str = "batch", batch: int | None = None) -> None:
    """One batch of requests through a job, committed at once.

    A batch that is already committed is left alone, and so is every request the job has decided before. Different requests
    of one id are told apart by ``one_per_id`` and logged.
    """
    if batch is not None and store.has_batch(source, batch):
        return
    base = store.snapshot()
    arrived = written(fresh(requests, base[REQUEST_LOG], job.__name__))
    todo, others = one_per_id(arrived)
    result = job(base, written(todo))
    commit(store, base, replace(result, rejected=result.rejected.unionByName(others)), source, batch)


def apply_stream(store: TableStore, requests: DataFrame, job: Callable[..., JobResult], checkpoint: str) -> StreamingQuery:
    """Requests through a job as they arrive, until the source is used up.

    The stream's own batch number goes into the commit, so a batch repeated after a failure is recognised.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        apply_requests(store, batch, job, f"stream:{job.__name__}:{checkpoint}", batch_id)

    return (
        requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
