"""Epoch seconds and local days. Nothing here depends on the session time zone."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.constants import TIME_ZONE
from tallyhouse.functions.predicates import all_of, closed_range

DAY = 86400


def local_date(epoch: Column, tz: str = TIME_ZONE) -> Column:
    wall = F.timestamp_add("SECOND", epoch, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), wall))


def day_text(epoch: Column, tz: str = TIME_ZONE) -> Column:
    """``YYYY-MM-DD`` of the local day an epoch second falls on."""
    return local_date(epoch, tz).cast("string")


def day_start(as_of: int, back: int = 0, tz: str = TIME_ZONE) -> int:
    """Epoch second ``back * 24h`` before the local midnight that opens the day of ``as_of``."""
    midnight = datetime.fromtimestamp(as_of, ZoneInfo(tz)).replace(hour=0, minute=0, second=0, microsecond=0)
    return int(midnight.timestamp()) - back * DAY


# Epoch seconds whose local day is a date in every time zone.
_FIRST, _LAST = 0, 253_402_128_000


def within(df: DataFrame, epoch: str, low: int | None = None, high: int | None = None, tz: str = TIME_ZONE) -> Column | None:
    """``low <= epoch <= high``, either end optional. On a table kept in ``day`` folders the days outside are not read.

    ``day`` is the local day of ``epoch``, as ``partition_by_day`` writes it; the exact bounds are tested in any case.
    """
    days: list[Column | None] = []
    if "day" in df.columns:
        for limit, side in ((low, Column.__ge__), (high, Column.__le__)):
            if limit not in (None, "") and _FIRST < limit < _LAST:
                days.append(side(F.col("day"), local_date(F.lit(limit).cast("bigint"), tz)))
    return all_of(closed_range(F.col(epoch), low, high), *days)


def date_spine(spark: SparkSession, as_of: int, days: int = 10, tz: str = TIME_ZONE) -> DataFrame:
    """The last ``days`` local days, newest first by ``pos``; its size is the parameter, not the data."""
    newest = F.lit(day_start(as_of, 0, tz)).cast("bigint")
    return spark.range(days).select(
        F.col("id").alias("pos"), day_text(newest - F.col("id") * DAY, tz).alias("date")
    )


def daily_counts(
    df: DataFrame, epoch: str, counted: str, after: int, as_of: int, days: int = 10, tz: str = TIME_ZONE
) -> DataFrame:
    """Rows per local day strictly after ``after``, every day of the spine present.

    The count shrinks to one row per day before any exchange, so a day holding most of the rows costs nothing extra.
    """
    counts = (
        df.where((F.col(epoch) > F.lit(after)) & within(df, epoch, after, None, tz))
        .groupBy(day_text(F.col(epoch), tz).alias("day"))
        .agg(F.count(counted).alias("n"))
    )
    spine = date_spine(df.sparkSession, as_of, days, tz)
    return spine.join(counts, spine.date == counts.day, "left").select(
        "pos", "date", F.coalesce("n", F.lit(0)).cast("bigint").alias("num")
    )
