"""Mixing sources to target weights over fixed-length token blocks; built-in column functions only.

The words of each source are laid end to end and cut into blocks of ``block`` words. For every output shard a multinomial
draw says how many of its slots each source gets. Draws are then held to the planned totals: slots that a source drew
beyond its plan go, in shard order, to sources that drew too few. The slots of a source are numbered over all shards and
mapped through a pseudorandom permutation of its block indexes, a new one for every pass over the source, so each block is
used equally often up to one; blocks then meet their slots by index. All randomness is a hash of ``seed`` and positions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"

BLOCK = 64  # words of a block
SHARD = 65_536  # slots of an output shard
DEALT = 1_000_000  # slots that one task lists, about
RANKED = 50_000  # rows of a source whose words are summed up in one window
ROUNDS = 4


class Mix(NamedTuple):
    """``rows``: every input row (doc_id, mark, copy, s, at, size); ``sources``: one row per source with its target;
    ``slots``: (shard, s, epoch, block); ``picks``: what the mix takes, (s, at, epoch, start, length) in words of the row."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    picks: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: s (from 1, by code point, null last), source, n_rows, source_size, target.

    Targets share ``share`` times all words by weight; none is above ``most`` times its source, the excess is reshared by
    weight. With sources in the order of limit / weight, the level of those that stay below their limit is the largest of
    (what is left after the limits before) / (weights from here on).
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    every = Window.partitionBy()  # one row per source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("s", F.row_number().over(order).cast("long"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(listed, (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("limit", most * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "s")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(ahead))
    target = F.least(F.col("limit"), F.max("level").over(every) * F.col("weight"))
    return per.select("s", "source", "n_rows", "source_size", target.alias("target"))


def _uniform(n: Column, *parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), n)


def _looked_up(points: DataFrame, intervals: DataFrame, total: int, n_intervals: int) -> DataFrame:
    """``points`` (column r in [0, total)) with the ``s`` of the interval (s, low, n) that holds r.

    Intervals lie end to end; both sides meet in as many equal cells as there are intervals, so that the join is on cells
    and an interval list of any length is shuffled, not copied.
    """
    width = max(1, -(-total // max(1, n_intervals)))
    first, last = F.expr(f"low div {width}L"), F.expr(f"(low + n - 1) div {width}L")
    cells = intervals.where("n > 0").withColumn("cell", F.explode(F.sequence(first, last)))
    met = points.withColumn("cell", F.expr(f"r div {width}L")).join(cells, "cell")
    return met.where("r >= low and r < low + n").drop("cell", "low", "n")


def _laid_out(items: DataFrame, n: str) -> DataFrame:
    """(s, low, n): counts end to end in the order of s; one row per source."""
    low = F.sum(n).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    return items.select("s", low.cast("long").alias("low"), F.col(n).cast("long").alias("n"))


def _half(value: Column, by: Column, modulus: Column, key: list[Column], turn: int) -> Column:
    return F.pmod(value + _uniform(modulus, *key, by, turn), modulus)


def _permuted(slots: DataFrame, seed: int) -> DataFrame:
    """Adds ``block``: the image of ``i`` under a permutation of [0, n_blocks) keyed by (seed, s, epoch).

    An alternating Feistel network over a grid of about sqrt(n) by sqrt(n) cells permutes the whole grid; an image beyond
    n_blocks is permuted again until it lies inside, which takes no more steps than the grid has spare cells.
    """
    key = [F.lit(seed), F.col("s"), F.col("epoch")]
    rows, columns = F.col("grid_rows"), F.col("grid_columns")

    def network(x: Column) -> Column:
        a, b = F.floor(x / columns), F.pmod(x, columns)
        for turn in range(ROUNDS):
            if turn % 2:
                a = _half(a, b, rows, key, turn)
            else:
                b = _half(b, a, columns, key, turn)
        return a * columns + b

    out = slots.withColumn("grid_rows", F.ceil(F.sqrt("n_blocks")).cast("long"))
    out = out.withColumn("grid_columns", F.ceil(F.col("n_blocks") / F.col("grid_rows")).cast("long"))
    out = out.withColumn("y", network(F.col("i")))
    spare = rows * columns - F.col("n_blocks")
    walked = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(spare, F.lit(1))), F.col("y"),
        lambda y, _: F.when(y < F.col("n_blocks"), y).otherwise(network(y)),
    )
    return out.withColumn("block", F.when(F.col("y") < F.col("n_blocks"), F.col("y")).otherwise(walked))


def mix(
    documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    block: int = BLOCK, seed: int = 7,
) -> Mix:
    """The mix of all rows of ``documents`` (doc_id, text, source); other columns only tell rows apart.

    A row's size is its number of words; null, empty and blank texts have size 0 and are never taken. A null source is a
    source of its own, a null doc_id a value like any other. Equal rows are told apart by ``copy``. No row is taken more
    than ``most`` times when that is a whole number. Sources without words have target 0; an empty table gives empty frames.
    """
    spark = documents.sparkSession
    sizes = written(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", row_mark(documents).alias("mark"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    sources = source_targets(sizes, weights, share, most)
    n_blocks = F.ceil(F.col("source_size") / block)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round((F.col("target") - F.col("whole") * F.col("source_size")) / block).cast("long")
    sources = written(
        sources.withColumn("n_blocks", n_blocks).withColumn("whole", whole).withColumn(
            "n_slots", F.col("whole") * F.col("n_blocks") + F.least(F.col("n_blocks"), rest)
        ).drop("whole")
    )

    # Words of a source end to end: hash parts of bounded size, a sum per part, a running sum inside.
    single = sizes.groupBy("doc_id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("copies"))
    single = single.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    known = sources.select("s", F.col("source").alias("_source"), "n_rows")
    dealt = single.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "mark", "copy"), F.ceil(F.col("n_rows") / RANKED))
    ).drop("source", "_source", "n_rows")
    upto = Window.unboundedPreceding, Window.currentRow
    parts = dealt.groupBy("s", "part").agg(F.sum("size").alias("words"))
    starts = parts.select(
        "s", "part", (F.sum("words").over(Window.partitionBy("s").orderBy("part").rowsBetween(*upto)) - F.col("words")).alias("low")
    )
    inside = F.sum("size").over(Window.partitionBy("s", "part").orderBy("doc_id", "mark", "copy").rowsBetween(*upto))
    rows = written(
        dealt.withColumn("inside", inside).join(starts, ["s", "part"]).select(
            "s", (F.col("low") + F.col("inside") - F.col("size")).alias("at"), "size", "doc_id", "mark", "copy"
        )
    )

    slots = written(_slots(spark, sources, seed))
    first, last = F.expr(f"at div {block}L"), F.expr(f"(at + size - 1) div {block}L")
    pieces = rows.where("size > 0").select("s", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("s", "block", "at", (begin - F.col("at")).alias("start"), (end - begin).alias("length"))
    picks = pieces.join(slots.select("s", "block", "epoch"), ["s", "block"])
    return Mix(rows, sources, slots, picks.select("s", "at", "epoch", "start", "length"))


def _slots(spark, sources: DataFrame, seed: int) -> DataFrame:
    """(shard, s, epoch, block): the block that each slot of each shard gets."""
    plan = _laid_out(sources.where("n_slots > 0"), "n_slots")
    totals = sources.where("n_slots > 0").agg(F.sum("n_slots"), F.count(F.lit(1))).first()
    n_slots, n_sources = int(totals[0] or 0), int(totals[1])
    points = spark.range(n_slots).select(
        F.expr(f"id div {SHARD}L").alias("shard"), _uniform(F.lit(max(1, n_slots)), seed, F.col("id")).alias("r")
    )
    drawn = _looked_up(points, plan, n_slots, n_sources).groupBy("shard", "s").agg(F.count(F.lit(1)).alias("drawn"))
    drawn = written(drawn)

    so_far = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = drawn.join(plan.select("s", F.col("n").alias("planned")), "s").withColumn(
        "before", F.sum("drawn").over(so_far) - F.col("drawn")
    )
    keep = F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("planned") - F.col("before")))
    held = held.withColumn("kept", keep)
    got = drawn.groupBy("s").agg(F.sum("drawn").alias("got"))
    missing = plan.join(got, "s", "left").select(
        "s", F.greatest(F.lit(0), F.col("n") - F.coalesce("got", F.lit(0))).alias("missing")
    )
    short = _laid_out(missing, "missing")
    # Slots drawn beyond the plan, numbered in the order of shards: one row per (shard, source) that overdrew.
    over = held.where("drawn > kept").select("shard", "s", (F.col("drawn") - F.col("kept")).alias("n"))
    low = F.sum("n").over(Window.orderBy("shard", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    over = over.withColumn("low", low)
    moved = over.select("shard", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("n") - 1)).alias("r"))
    n_moved = int(over.agg(F.sum("n")).first()[0] or 0)
    given = _looked_up(moved, short, n_moved, n_sources).groupBy("shard", "s").agg(F.count(F.lit(1)).alias("kept"))
    counts = held.select("shard", "s", "kept").unionByName(given).groupBy("shard", "s").agg(F.sum("kept").alias("n"))
    counts = counts.where("n > 0").withColumn("low", F.sum("n").over(so_far) - F.col("n"))

    # A row stands for up to SHARD slots: dealt out by their number, not by the bytes of the rows.
    counts = counts.repartition(n_slots // DEALT + 1, "shard", "s")
    number = F.explode(F.sequence(F.col("low"), F.col("low") + F.col("n") - 1)).alias("number")
    numbered = counts.select("shard", "s", number).join(sources.select("s", "n_blocks"), "s")
    numbered = numbered.withColumn("epoch", F.expr("number div n_blocks")).withColumn("i", F.expr("number % n_blocks"))
    return _permuted(numbered, seed).select("shard", "s", "epoch", "block")


def row_mark(documents: DataFrame) -> Column:
    """A 64-bit mark of the row's content; rows that share it and a doc_id count as copies."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns])


def taken_words(documents: DataFrame, **settings) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    mixed = mix(documents, **settings)
    taken = mixed.picks.groupBy("s", "at").agg(F.sum("length").alias("taken"))
    rows = mixed.rows.where("size > 0").join(taken, ["s", "at"], "left")
    rows = rows.unionByName(mixed.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return rows.join(mixed.sources.select("s", "source_size", "target"), "s").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(documents: DataFrame, **settings) -> DataFrame:
    """The mix as documents: one row per document row and pass over its source in which it is taken.

    A pass that takes every word keeps the text as it is; otherwise the text is what the taken blocks hold of it, in order,
    each word with the white space after it. Columns are those of ``documents``; ``n_chars``, if there, follows the text.
    """
    mixed = mix(documents, **settings)
    runs = mixed.picks.groupBy("s", "at", "epoch").agg(
        F.sum("length").alias("words"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs")
    )  # pieces of one document: as many as its blocks
    rows = mixed.rows.where("size > 0").join(runs, ["s", "at"]).groupBy("mark").agg(
        F.collect_list(F.struct("size", "words", "runs", "copy", "epoch")).alias("taken")
    )
    # Texts move once: copies are numbered and met by their picks under one partitioning.
    marked = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), row_mark(documents).alias("mark")
    )
    marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy("mark").orderBy("mark")))
    met = marked.join(rows, "mark").withColumn("taken", F.filter("taken", lambda t: t["copy"] == F.col("nth")))
    out = met.select("row", F.explode("taken").alias("t"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD_AND_GAP), F.lit(0))
    part = F.array_join(
        F.flatten(F.transform(F.col("t.runs"), lambda r: F.slice("words", r["start"].cast("int") + 1, r["length"].cast("int")))), ""
    )
    split = out.where("t.words < t.size").withColumn("words", words).select("row", part.alias("text"))
    texts = out.where("t.words = t.size").select("row", F.col("row.text").alias("text")).unionByName(split)
    kinds = dict(documents.dtypes)

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.length("text").cast(kinds[c]).alias(c)
        return F.col("row")[c].alias(c)

    return texts.select(*[column(c) for c in documents.columns])
