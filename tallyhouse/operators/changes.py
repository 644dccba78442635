"""Keyed changes to a table: append, update, delete, upsert, and the checks that split requests.

State tables are large and request batches are small. Every existence check therefore first cuts the state to the keys
asked for (a left semi join, whose request side Spark broadcasts when it measures it small) and every update joins the
changes to the state from the right, so the state itself stays where it is unless the batch is large too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_of(*columns: str) -> Column:
    """Comparable position of a request in its batch."""
    return F.struct(*columns)


def latest(requests: DataFrame, keys: Sequence[str], order: Column, *columns: str) -> DataFrame:
    """Per key the values of its last request; combines before the shuffle, so a hot key is one row per task."""
    newest = F.max_by(F.struct(*columns), order).alias("_last")
    return requests.groupBy(*keys).agg(newest).select(*keys, "_last.*")


def earliest(requests: DataFrame, keys: Sequence[str], order: Column, name: str = "_first") -> DataFrame:
    return requests.groupBy(*keys).agg(F.min(order).alias(name))


def cut_to(state: DataFrame, key: str, requests: DataFrame, request_key: str) -> DataFrame:
    """State rows whose key some request mentions."""
    asked = requests.select(F.col(request_key).alias("_asked")).where(F.col("_asked").isNotNull()).distinct()
    return state.join(asked, state[key] == asked["_asked"], "left_semi")


def count_matches(
    requests: DataFrame, request_key: str, state: DataFrame, key: str, name: str
) -> DataFrame:
    """Requests with ``name`` = how many state rows carry their key (0 when none)."""
    counts = (
        cut_to(state.select(key), key, requests, request_key)
        .groupBy(F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    return (
        requests.join(counts, requests[request_key] == counts["_key"], "left")
        .withColumn(name, F.coalesce("_count", F.lit(0)))
        .drop("_key", "_count")
    )


def judged(requests: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
    """Requests with ``reason``: the first check that fails them, NULL for the accepted. NULL tests do not fail."""
    reason = F.lit(None).cast("string")
    for name, fails in reversed(checks):
        reason = F.when(fails, F.lit(name)).otherwise(reason)
    return requests.withColumn("reason", reason)


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("reason").isNull()).drop("reason")


def rejected(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("reason").isNotNull()).select("req_id", "reason")


def append(state: DataFrame, rows: DataFrame) -> DataFrame:
    """State plus rows; columns the rows do not have stay NULL."""
    return state.unionByName(rows, allowMissingColumns=True)


def update(state: DataFrame, changes: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """State with ``values`` put in where a change with the same keys exists.

    ``changes`` holds one row per key and is seen as the struct ``change`` inside ``values``.
    """
    fields = [c for c in changes.columns if c not in keys]
    packed = changes.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.struct(F.lit(True).alias("_hit"), *fields).alias("change")
    )
    on = [state[k] == packed[f"_key_{k}"] for k in keys]
    joined = state.join(packed, on, "left")
    hit = F.col("change").isNotNull()
    return joined.select(
        *[
            F.when(hit, values[c]).otherwise(F.col(c)).cast(state.schema[c].dataType.simpleString()).alias(c)
            if c in values
            else F.col(c)
            for c in state.columns
        ]
    )


def delete(state: DataFrame, keys: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """State without the rows named in ``keys``; ``on`` maps state columns to key columns."""
    wanted = keys.select(*[F.col(right).alias(f"_del_{left}") for left, right in on.items()]).distinct()
    match = [state[left] == wanted[f"_del_{left}"] for left in on]
    return state.join(wanted, match, "left_anti")


def upsert(state: DataFrame, rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Rows replace state rows of the same key; with ``order`` the last row per key counts."""
    fresh = rows
    if order is not None:
        others = [c for c in state.columns if c != key]
        fresh = latest(rows, [key], order, *others)
    return append(delete(state, fresh, {key: key}), fresh.select(*state.columns))


def evolve(
    df: DataFrame,
    add: Mapping[str, tuple[str, Column | None]],
    retype: Mapping[str, str] | None = None,
    backfill: Sequence[tuple[Column, str, Column]] = (),
) -> DataFrame:
    """Adds columns with defaults, changes types, then overwrites single values where a condition holds."""
    for name, (kind, default) in add.items():
        df = df.withColumn(name, (F.lit(None) if default is None else default).cast(kind))
    for name, kind in (retype or {}).items():
        df = df.withColumn(name, F.col(name).cast(kind))
    for condition, name, value in backfill:
        df = df.withColumn(name, F.when(condition, value).otherwise(F.col(name)))
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that break uniqueness, NULL keys left out; empty when the constraint holds."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
