"""What happened to a group just before and just after given moments, for groups of any size.

Moments and events are laid into one order by (group, place) and dealt out in ranges of it, so a group with most of the rows
is split over tasks. Inside a range the last and the next event are carried along the order; what the neighbouring ranges
contribute is a prefix scan over one row per group and range. The work is linear in moments and events together, where a
join on the group would form every pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.operators.scratch import written


def around(
    moments: DataFrame, events: DataFrame, group: str, at: str, who: str, partitions: int | None = None, ahead: bool = True,
    ranges: int | None = None, own: str | None = None,
) -> DataFrame:
    """``moments`` with ``before``, the struct (at, who) of the last event earlier than the moment, and ``next_other``, the
    place of the first later event of somebody else. Without ``ahead`` only ``before`` is worked out.

    Both sides have ``group``, ``at`` (comparable) and ``who``; moments may have further columns. Events of one group have
    different places; one at the moment itself counts as later. Where there is no such event the results are null. A group
    without moments gives no rows. A null group or who equals other nulls.

    ``ranges`` tells that places were ``dealt`` out before, in so many ranges. These then serve here, each bounded in rows,
    without laying anything into order again; only for looking back. With ``own``, a boolean column of the moments, those for
    which it holds are events as well.
    """
    c = F.col
    kept = F.struct(*[F.col(f"`{name}`") for name in moments.columns])
    same = [c(group).alias("_g"), c(at).alias("_at"), c(who).alias("_who")]
    rows = moments.select(*same, kept.alias("_moment"))
    if own:
        sides = F.when(c(f"_moment.{own}"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        rows = rows.withColumn("_own", F.explode(sides)).withColumn("_moment", F.when(~c("_own"), c("_moment"))).drop("_own")
    both = rows.unionByName(events.select(*same), allowMissingColumns=True)
    event = F.struct(c("_at").alias("at"), c("_who").alias("who"))
    if ranges:
        if ahead:
            raise ValueError("dealt places serve for looking back only")
        both = both.withColumn("_range", c("_at.part"))
        # Without borders no neighbour is read.
        return _looked_back(written(both) if ranges > 1 else both, event, [F.asc("_at"), c("_moment").isNull().asc()], ranges > 1)
    order = [F.asc("_g"), F.asc("_at"), c("_moment").isNull().asc()]
    place = F.monotonically_increasing_id()
    dealt = both.repartitionByRange(partitions, *order) if partitions else both.repartitionByRange(*order)
    # Written once: boundaries drawn again could move rows between ranges.
    ranged = written(
        dealt.sortWithinPartitions(*order).select(
            "*", F.shiftright(place, 33).cast("int").alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")
        )
    )
    if not ahead:
        return _looked_back(ranged, event, ["_pos"], True)
    is_event = c("_moment").isNull()
    inside = Window.partitionBy("_range", "_g")
    earlier = inside.orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("_g")
    up = ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_last", F.last(F.when(is_event, event), ignorenulls=True).over(earlier))
    later = inside.orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, -1)

    # A turn is an event of somebody else than the event before it.
    turn = is_event & (c("_last").isNull() | ~c("_last.who").eqNullSafe(c("_who")))
    rows = rows.withColumn("_turn", F.last(F.when(turn, F.struct("_at")), ignorenulls=True).over(later))
    coming = F.struct(c("_at").alias("at"), c("_who").alias("who"), c("_turn._at").alias("turn"))
    rows = rows.withColumn("_next", F.last(F.when(is_event, coming), ignorenulls=True).over(later))

    # Groups that go on in other ranges: what those hold of them.
    parts = rows.where(is_event).groupBy("_g", "_range").agg(
        F.min_by(coming, "_pos").alias("first"), F.max_by(event, "_pos").alias("last")
    )
    spans = ranged.groupBy("_g", "_range").agg(F.lit(1).alias("_one")).join(parts.withColumnsRenamed({"_g": "_pg", "_range": "_pr"}),
        c("_g").eqNullSafe(c("_pg")) & (c("_range") == c("_pr")), "left")
    down = ranges.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("c_last", F.last("last", ignorenulls=True).over(up))
    begins = c("first").isNotNull() & (c("c_last").isNull() | ~c("c_last.who").eqNullSafe(c("first.who")))
    own_turn = F.when(begins, c("first.at")).otherwise(c("first.turn"))
    spans = spans.withColumn("c_turn", F.last(own_turn, ignorenulls=True).over(down))
    resolved = F.struct(c("first.at").alias("at"), c("first.who").alias("who"), F.coalesce("first.turn", "c_turn").alias("turn"))
    spans = spans.withColumn("c_next", F.last(F.when(c("first").isNotNull(), resolved), ignorenulls=True).over(down))
    carried = spans.where("c_last is not null or c_next is not null").select(
        c("_g").alias("_cg"), c("_range").alias("_cr"), "c_last", "c_turn", "c_next"
    )

    found = rows.where(~is_event).join(carried, c("_g").eqNullSafe(c("_cg")) & (c("_range") == c("_cr")), "left")
    in_range = F.struct(c("_next.at").alias("at"), c("_next.who").alias("who"), F.coalesce("_next.turn", "c_turn").alias("turn"))
    coming = F.when(c("_next").isNotNull(), in_range).otherwise(c("c_next"))
    other = F.when(~coming["who"].eqNullSafe(c("_who")), coming["at"]).otherwise(coming["turn"])
    return found.select(
        "_moment.*", F.coalesce("_last", "c_last").alias("before"), F.when(coming.isNotNull(), other).alias("next_other")
    )


def dealt(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` in ranges of the place ``at``, which becomes (part, place): the number of its range and the place itself.

    To be written once: ranges drawn again could have other borders.
    """
    place = F.struct(F.spark_partition_id().alias("part"), F.col(at).alias("place"))
    return rows.repartitionByRange(at).withColumn(at, place)


def _looked_back(ranged: DataFrame, event: Column, order: Sequence[str | Column], borders: bool) -> DataFrame:
    """The moments of ``ranged`` with ``before`` alone; ``order`` is that of rows of one group in one range."""
    c = F.col
    is_event = c("_moment").isNull()
    earlier = Window.partitionBy("_range", "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_last", F.last(F.when(is_event, event), ignorenulls=True).over(earlier)).where(~is_event)
    if not borders:
        return rows.select("_moment.*", c("_last").alias("before"))
    up = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranged.groupBy("_g", "_range").agg(F.max_by(event, F.when(is_event, c("_at"))).alias("last"))
    carried = spans.select(
        c("_g").alias("_cg"), c("_range").alias("_cr"), F.last("last", ignorenulls=True).over(up).alias("c_last")
    ).where("c_last is not null")
    found = rows.join(carried, c("_g").eqNullSafe(c("_cg")) & (c("_range") == c("_cr")), "left")
    return found.select("_moment.*", F.coalesce("_last", "c_last").alias("before"))
