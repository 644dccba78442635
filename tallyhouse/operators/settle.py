"""First-come-first-served decisions where an accepted request blocks later ones.

A request is accepted unless an earlier *accepted* request blocks one of its keys. Done one by one that is a driver
loop over rows; here each round decides every request that no undecided earlier request can block, plus everything the
newly accepted ones block. A round is a few aggregations and joins over the undecided rows only.

Conflicts at random leave a small share of the rows to the next round. A chain, where each request waits for the one before,
would leave nearly all: a round that decides less than ``1 - STALLED`` of its rows is followed by a walk over the earliest
``BLOCK`` undecided requests, in one task of that bounded size. So rounds together touch at most ``1 / (1 - STALLED)`` times
the requests, and a walk settles ``BLOCK`` more at the cost of one pass over what is still undecided.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.scratch import written

_COMPACT_EVERY = 16
STALLED = 0.9
BLOCK = 2_000


def _earliest_per_key(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Earliest order per key over several key columns; combined before the shuffle, so hot keys stay small."""
    keys = [df.select(F.col(c).alias("_key"), F.col(order).alias("_o")) for c in columns]
    stacked = reduce(DataFrame.unionByName, keys).where(F.col("_key").isNotNull())
    return stacked.groupBy("_key").agg(F.min("_o").alias("_o"))


def _flag_earlier(df: DataFrame, columns: Sequence[str], order: str, blockers: DataFrame, name: str) -> DataFrame:
    """Flags rows for which some key column has a blocker of smaller order."""
    flag = F.lit(False)
    for i, column in enumerate(columns):
        side = blockers.select(F.col("_key").alias(f"_k{i}"), F.col("_o").alias(f"_o{i}"))
        df = df.join(side, df[column] == side[f"_k{i}"], "left")
        flag = flag | F.coalesce(F.col(f"_o{i}") < F.col(order), F.lit(False))
    extra = [f"_{kind}{i}" for i in range(len(columns)) for kind in ("k", "o")]
    return df.withColumn(name, flag).drop(*extra)


def _walked(undecided: DataFrame, order: str, blocks: Sequence[str], blocked_by: Sequence[str]) -> DataFrame:
    """(order, accepted) of the earliest ``BLOCK`` requests, decided one after the other.

    Nothing undecided comes before them and no request accepted so far blocks them, so they decide among themselves.
    """
    def keys(columns: Sequence[str]) -> Column:
        return F.filter(F.array(*[F.col(c) for c in columns]), lambda key: key.isNotNull())

    first = undecided.orderBy(order).limit(BLOCK).select(
        F.col(order).alias("o"), keys(blocks).alias("blocks"), keys(blocked_by).alias("by")
    )
    listed = first.agg(F.array_sort(F.collect_list(F.struct("o", "blocks", "by"))).alias("requests"))
    kinds = dict(first.dtypes)
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast(f"array<{kinds['o']}>").alias("won"))

    def step(state: Column, request: Column) -> Column:
        free = ~F.arrays_overlap(state["taken"], request["by"])
        return F.struct(
            F.when(free, F.concat(state["taken"], request["blocks"])).otherwise(state["taken"]).alias("taken"),
            F.when(free, F.array_append(state["won"], request["o"])).otherwise(state["won"]).alias("won"),
        )

    ended = listed.select("requests", F.aggregate("requests", start, step, lambda state: state["won"]).alias("won"))
    decided = ended.select(F.explode("requests.o").alias("_walked"), "won")
    return decided.select("_walked", F.array_contains("won", F.col("_walked")).alias("_won"))


def _after_walk(undecided: DataFrame, order: str, blocks: Sequence[str], blocked_by: Sequence[str]) -> DataFrame:
    """``undecided`` with ``accepted``: the walked requests and those that the accepted ones among them block."""
    decided = F.broadcast(written(_walked(undecided, order, blocks, blocked_by)))  # BLOCK rows
    met = undecided.join(decided, undecided[order] == decided["_walked"], "left")
    taken = _earliest_per_key(undecided.join(F.broadcast(decided.where("_won")), F.col(order) == F.col("_walked")), blocks, order)
    flagged = _flag_earlier(met, blocked_by, order, taken, "_blocked")
    outcome = F.when(F.col("_walked").isNotNull(), F.col("_won")).when(F.col("_blocked"), False)
    return flagged.withColumn("accepted", outcome).drop("_walked", "_won", "_blocked")


def settle(requests: DataFrame, order: str, blocks: Sequence[str], blocked_by: Sequence[str]) -> DataFrame:
    """``requests`` with a boolean ``accepted``.

    ``order`` is a unique comparable column; ``blocks`` and ``blocked_by`` name text columns holding keys (NULL = none).
    """
    undecided = written(requests)
    left, stalled = undecided.count(), False
    decided: list[DataFrame] = []
    while left:
        if stalled:
            judged = _after_walk(undecided, order, blocks, blocked_by)
        else:
            waiting = _flag_earlier(
                undecided, blocked_by, order, _earliest_per_key(undecided, blocks, order), "_waits"
            )
            taken = _earliest_per_key(waiting.where(~F.col("_waits")), blocks, order)
            flagged = _flag_earlier(waiting, blocked_by, order, taken, "_blocked")
            outcome = F.when(~F.col("_waits"), True).when(F.col("_blocked"), False)
            judged = flagged.withColumn("accepted", outcome).drop("_waits", "_blocked")
        round_ = written(judged)
        decided.append(round_.where(F.col("accepted").isNotNull()))
        if len(decided) == _COMPACT_EVERY:
            decided = [written(reduce(DataFrame.unionByName, decided))]
        undecided = round_.where(F.col("accepted").isNull()).drop("accepted")
        before, left = left, undecided.count()
        # After a walk rounds are tried again: what it has settled may free many at once.
        stalled = not stalled and left > STALLED * before
    if not decided:
        return requests.withColumn("accepted", F.lit(True))
    return reduce(DataFrame.unionByName, decided)
