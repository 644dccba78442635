"""Keys that hold many rows, found by a mergeable heavy-hitter sketch.

A sketch of a table's key is one small row: every task sketches its own rows and only the sketches meet, so counting takes
one scan of the key columns and no shuffle of keys. Sketches of parts of a table combine into that of the whole, so they can
be kept beside a table and grow with its appends (see ``sources.tables``). A key with more than ``1 / TRACKED`` of the rows
several times over is always among those found; a rarer one is no larger than what any task reads.

What a sketch says only decides how work is split. Results are the same whatever it says, so an outdated one costs time only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = 8192  # keys a sketch follows
LISTED = 1000  # hot keys of a table at most: beyond that each would hold less than a thousandth of it

# (application, key columns' plan, rows per part) -> hot keys; sketches of one session's tables are taken once.
_known: dict[tuple, dict[int, int]] = {}


def key_hash(*keys: Column) -> Column:
    """The 64-bit number under which a key is counted. Different keys with one number are taken for one hot key."""
    return F.xxhash64(*[key.cast("string") for key in keys])


def key_sketch(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (sketch, rows) for the rows of ``df`` whose keys are not null."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    hashed = present.select(key_hash(*[F.col(k) for k in keys]).alias("_key"))
    return hashed.agg(F.expr(f"approx_top_k_accumulate(_key, {TRACKED})").alias("sketch"), F.count(F.lit(1)).alias("rows"))


def combined(sketches: DataFrame) -> DataFrame:
    """The sketch of all parts from the sketches of each."""
    return sketches.agg(F.expr("approx_top_k_combine(sketch)").alias("sketch"), F.sum("rows").alias("rows"))


def hot_keys(sketch: DataFrame, rows: int) -> dict[int, int]:
    """Hash of each key with more than about ``rows`` rows, and its rows; at most ``LISTED`` of them reach the driver."""
    found = sketch.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {LISTED})")).alias("key"))
    return {r[0]: r[1] for r in found.where(F.col("key.count") > rows).select("key.item", "key.count").collect()}


def measured(df: DataFrame, keys: Sequence[str], rows: int) -> Mapping[int, int]:
    """The hot keys of ``df``; one pass over its key columns the first time a session asks."""
    at = (df.sparkSession.sparkContext.applicationId, df.select(*keys).semanticHash(), rows)
    if at not in _known:
        _known[at] = hot_keys(key_sketch(df, keys), rows)
    return _known[at]
