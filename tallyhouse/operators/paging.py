"""Newest-first numbering and paging.

Two ways to the same numbers:

* ``first_page_rows`` + ``number_head``: a page near the front. Only ``offset + row`` rows survive the per-task top-k,
  so one small task numbers them.
* ``number_rows``: every row numbered. Rows are range-partitioned on the whole sort key, each partition counts its own
  rows, and the partition offsets (one row per partition) are joined back. No task sees more than its range.

``ListReport.page`` takes the first for pages that end within ``DEEP_PAGE`` rows and the second beyond.

A sort key always ends in something unique, so tied times neither reorder between runs nor pile up in one range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.operators.scratch import written

# Rows one task may sort for a page; pages ending further back are cut from the distributed numbering.
DEEP_PAGE = 100_000


@dataclass(frozen=True)
class Order:
    """A total order by column names: ``lead`` ascending, ``newest`` descending with NULLs first, ``ties`` ascending."""

    newest: str
    ties: tuple[str, ...] = ()
    lead: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.lead, self.newest, *self.ties)

    def columns(self) -> list[Column]:
        return [
            *[F.asc_nulls_first(c) for c in self.lead],
            F.desc_nulls_first(self.newest),
            *[F.asc_nulls_first(c) for c in self.ties],
        ]

    def renamed(self, prefix: str) -> Order:
        return Order(
            f"{prefix}{self.newest}",
            tuple(f"{prefix}{c}" for c in self.ties),
            tuple(f"{prefix}{c}" for c in self.lead),
        )


def newest_first(column: str, *ties: str, lead: tuple[str, ...] = ()) -> Order:
    return Order(column, ties, lead)


def page_bounds(page: int, row: int) -> tuple[int, int]:
    """``(after, upto)``: the page holds the numbers ``after < rn <= upto``. Pages below 1 behave as page 1."""
    if row < 0:
        raise ValueError("row must not be negative")
    after = max(page - 1, 0) * row
    return after, after + row


def number_head(head: DataFrame, order: Sequence[Column], after: int, upto: int) -> DataFrame:
    """Numbers an already limited head and keeps one page of it."""
    rn = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return head.withColumn("rn", rn).where((F.col("rn") > after) & (F.col("rn") <= upto))


def first_page_rows(df: DataFrame, order: Sequence[Column], upto: int) -> DataFrame:
    return df.orderBy(*order).limit(upto)


def number_rows(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``df`` with ``rn`` = 1-based position in ``order``, for any number of rows.

    The sorted ranges are written once: drawing the range boundaries a second time could move rows between partitions
    after their offsets were counted.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id()
    sorted_rows = written(
        ranged.sortWithinPartitions(*order).select(
            "*",
            F.shiftright(place, 33).cast("int").alias("_range"),
            place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
        )
    )
    sizes = sorted_rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # One row per range partition: the size of the broadcast is the shuffle width, not the data.
    return (
        sorted_rows.join(F.broadcast(offsets), "_range")
        .withColumn("rn", (F.col("_before") + F.col("_pos") + 1).cast("bigint"))
        .drop("_range", "_pos", "_before")
    )


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))
