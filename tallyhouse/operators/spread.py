"""Left joins whose right side may hold a large share of its rows under one key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import hotkeys

# Rows of one key that one task may join; keys with more are split into that many parts.
HOT_ROWS = 1_000_000


def spread_join(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    distinct: bool = False,
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """``left`` left join ``right``, hot keys of ``right`` split over tasks.

    ``hot`` are key hashes that hold many rows, measured by a sketch when not given. Without any this is the plain join. Else
    the rows of a hot key get one of the key's parts and each left row of that key meets every part, so every pair is formed
    once. Equal rows of ``right`` travel as one row with their number and are split into numbered chunks, so the part of a
    row depends on its content alone and a task that runs again deals the same rows. Which keys really have rows is read
    from ``right``, so a wrong or outdated ``hot`` changes no result. ``distinct``: no two rows of ``right`` are equal.
    """
    hot = hotkeys.measured(right, right_on, HOT_ROWS) if hot is None else hot
    if not hot:
        return left.join(right, [left[a] == right[b] for a, b in zip(left_on, right_on, strict=True)], "left")

    listed = F.coalesce(hotkeys.key_hash(*[right[b] for b in right_on]).isin(list(hot)), F.lit(False))
    some, many = right.where(~listed), right.where(listed)
    names = [f"_hot{i}" for i in range(len(right_on))]
    counted = many.groupBy(*[F.col(b).alias(n) for b, n in zip(right_on, names, strict=True)]).agg(F.count(F.lit(1)).alias("_rows"))
    # The keys a sketch lists are few, whatever the table holds.
    parts = F.broadcast(counted.select(*names, F.ceil(F.col("_rows") / F.lit(HOT_ROWS)).alias("_parts")))

    if distinct:
        many = many.withColumn("_copies", F.lit(1).cast("bigint")).withColumn("_chunk", F.lit(0).cast("bigint"))
    else:
        many = many.groupBy(*right.columns).agg(F.count(F.lit(1)).alias("_equal"))
        last = F.expr(f"(_equal - 1) div {HOT_ROWS}")
        many = many.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        rest = F.col("_equal") - F.col("_chunk") * HOT_ROWS
        many = many.withColumn("_copies", F.least(F.lit(HOT_ROWS).cast("bigint"), rest)).drop("_equal")
    in_right = [many[b] == parts[n] for b, n in zip(right_on, names, strict=True)]
    part = F.pmod(F.xxhash64(*right.columns, "_chunk"), F.col("_parts")).cast("bigint")
    many = many.join(parts, in_right).select(*right.columns, "_copies", part.alias("_right_part"))
    some = some.select(
        *right.columns, F.lit(1).cast("bigint").alias("_copies"), F.lit(0).cast("bigint").alias("_right_part")
    )
    parted = some.unionByName(many)

    in_left = [left[a] == parts[n] for a, n in zip(left_on, names, strict=True)]
    last = F.coalesce(F.col("_parts") - 1, F.lit(0).cast("bigint"))
    copies = left.join(parts, in_left, "left").select(
        *left.columns, F.col("_parts").isNotNull().alias("_split"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_left_part"),
    )
    on = [copies[a] == parted[b] for a, b in zip(left_on, right_on, strict=True)]
    joined = copies.join(parted, [*on, copies["_left_part"] == parted["_right_part"]], "left")
    # A left row of a split key has a match in some part; its copies without one go.
    joined = joined.where(~F.col("_split") | F.col("_right_part").isNotNull())
    if not distinct:
        again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("_copies", F.lit(1).cast("bigint"))))
        joined = joined.withColumn("_copy", again).drop("_copy")
    return joined.drop("_split", "_left_part", "_right_part", "_copies")
