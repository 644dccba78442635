"""The rows that hold given ranks of an order, found without sorting or writing the relation.

Rows are counted per range of the leading sort column, and only the range that holds the wanted ranks is looked into further:
into finer ranges of the same column, or, once it is a single value, into the next column. What is left is little more than
the page and the rows tied with it; only that is sorted, in ranges over the whole sort key.

A row may stand for several result rows (``_rows``), those that lookups make of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyhouse.functions.predicates import all_of
from tallyhouse.operators.paging import Order
from tallyhouse.operators.scratch import written

BUCKETS = 1024  # ranges of a column that are counted at once; so many rows reach the driver
ENOUGH = 100_000  # result rows that need no further narrowing: one range of the final sort

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Cut:
    """The rows for which ``where`` holds are those of the ranks ``skipped + 1`` to ``skipped + held``."""

    where: Column | None
    skipped: int
    held: int

    def of(self, df: DataFrame) -> DataFrame:
        return df if self.where is None else df.where(self.where)


def _buckets(keys: DataFrame, column: str, descending: bool, low: int, high: int, width: int) -> list[tuple[int, int]]:
    """(bucket, result rows) in sort order; bucket -1 holds the nulls."""
    value = f"cast(`{column}` as decimal(20, 0))"  # differences of any two longs fit
    offset = f"{high}bd - {value}" if descending else f"{value} - ({low}bd)"
    at = F.coalesce(F.expr(f"({offset}) div {width}bd"), F.lit(-1))
    counted = keys.groupBy(at.alias("bucket")).agg(F.sum("_rows").alias("rows"))
    return sorted((r["bucket"], r["rows"]) for r in counted.collect())


def _narrowed(keys: DataFrame, column: str, descending: bool, nulls: bool, cut: Cut, after: int, upto: int) -> tuple[Cut, bool]:
    """The cut within ``column``, and whether it is down to one value of it."""
    span = cut.of(keys).agg(F.min(column), F.max(column)).first()
    low, high = (0, 0) if span[0] is None else (int(span[0]), int(span[1]))
    where, skipped = cut.where, cut.skipped
    while True:
        width = -(-(high - low + 1) // BUCKETS)
        inside = F.col(column).between(low, high)
        counted = _buckets(keys.where(all_of(where, inside | F.col(column).isNull() if nulls else inside)), column, descending, low, high, width)
        ends, total = [], skipped
        for bucket, rows in counted:
            total += rows
            ends.append((bucket, total))
        first = next((i for i, (_, end) in enumerate(ends) if end > after), None)
        if first is None:
            return Cut(F.lit(False), total, 0), False
        last = next((i for i, (_, end) in enumerate(ends) if end >= upto), len(ends) - 1)
        skipped = ends[first - 1][1] if first else skipped
        held = ends[last][1] - skipped
        a, b = ends[first][0], ends[last][0]
        nulls = a == -1
        if b == -1:
            return Cut(all_of(where, F.col(column).isNull()), skipped, held), True
        a, before = max(a, 0), high - low
        if descending:
            low, high = max(low, high - (b + 1) * width + 1), high - a * width
        else:
            low, high = low + a * width, min(high, low + (b + 1) * width - 1)
        inside = F.col(column).between(low, high)
        now = Cut(all_of(where, inside | F.col(column).isNull() if nulls else inside), skipped, held)
        if low == high and not nulls:
            return now, True
        # A range that is no longer halved is about as wide as the page itself.
        if held <= ENOUGH or width == 1 or 2 * (high - low) > before:
            return now, False


def cut_for(keys: DataFrame, order: Order, after: int, upto: int) -> Cut:
    """A cut that holds the ranks ``after < rank <= upto``; ``keys`` has the columns of ``order`` and ``_rows``.

    Whole-number columns are narrowed; a column of another type ends it. Every step is one pass over the sort columns, in
    which a filter on a stored column reaches the scan.
    """
    total = keys.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    cut = Cut(None, 0, total)
    for column in order.names:
        if cut.held <= ENOUGH or not isinstance(keys.schema[column].dataType, _WHOLE):
            break
        cut, single = _narrowed(keys, column, column == order.newest, True, cut, after, upto)
        if not single:
            break
    return cut


def placed(rows: DataFrame, order: Order) -> DataFrame:
    """``rows`` with ``_before``, the result rows in front of each; sorted in ranges, written once, no task holds more than one."""
    columns = order.columns()
    place = F.monotonically_increasing_id()
    ranged = written(
        rows.repartitionByRange(*columns).sortWithinPartitions(*columns).select(
            "*", F.shiftright(place, 33).cast("int").alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")
        )
    )
    inside = Window.partitionBy("_range").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.sum("_rows").alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    # One row per range partition: the size of the broadcast is the shuffle width, not the data.
    joined = ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    before = F.col("_offset") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))
    return joined.withColumn("_before", before).drop("_range", "_pos", "_r", "_offset")
