"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Best-fit decreasing looks at lengths only, so it runs over counts per length (at most ``capacity`` of them) instead of
documents. The plan says which ranks of a length go to which run of sequences; pieces are ranked within their length and
take their slots by joining on (length, rank). Nothing but the histogram reaches the driver, and nothing but the plan,
whose size is bounded by the capacity and not by the data, is broadcast.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import pieces_of, written

# Rows of one length that are ranked in one window; longer runs are split by a hash.
RANKED = 50_000

PLAN = "length long, rank_from long, rank_to long, first_sequence long, per_sequence long, at long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file; ranks are its ids, so ids equal those of the tokenizers library."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # Fixed: the printable bytes that stand for themselves in such vocabularies; all others follow from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = spec["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_pieces(
    documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """Token pieces of whole texts: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null text counts as empty and gives the one token ``end_id``. Only documents of more than ``capacity`` tokens are cut:
    into full pieces, the first of which takes the remainder. Repeated rows and null doc_ids each give their own pieces;
    further columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_to_numpy
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                rows = []
                names = batch.column("doc_id").to_pylist()
                for doc_id, text in zip(names, batch.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text or "", allowed_special="all"), end_id).astype("<u4")
                    cut = len(ids) % capacity or capacity
                    starts = [0, *range(cut, len(ids), capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        own = ids[a:b]
                        row = (doc_id, k, a, b - a, zlib.crc32(own.tobytes()))
                        rows.append((*row, own.astype(np.int32)) if with_ids else row)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                columns = list(zip(*rows, strict=True))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, types[: len(columns)], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of ``PLAN``.

    Ranks [rank_from, rank_to) of a length fill consecutive sequences from ``first_sequence`` on, ``per_sequence`` to each,
    the first of them at offset ``at``. Each piece goes where the least room that still fits it is left.
    """
    plan = []
    rooms: list[int] = []  # distinct rooms left, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    used = 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                insort(rooms, room)
            runs.setdefault(room, []).append((first, n))

    def fill(length: int, rank: int, left: int, room: int, first: int, n: int) -> tuple[int, int]:
        """Puts up to ``left`` pieces into a run; returns how many went in and how many sequences they took."""
        per = room // length
        full = min(n, left // per)
        at = capacity - room
        if full:
            plan.append((length, rank, rank + full * per, first, per, at))
            add(room - per * length, first, full)
        taken, last = full * per, left - full * per
        if full < n and last:
            last = min(last, per)
            plan.append((length, rank + taken, rank + taken + last, first + full, last, at))
            add(room - last * length, first + full, 1)
            return taken + last, full + 1
        return taken, full

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for room in rooms[bisect_left(rooms, length) :]:
            if not left:
                break
            own = runs.pop(room)
            rooms.remove(room)
            for first, n in own:
                taken, took = fill(length, rank, left, room, first, n) if left else (0, 0)
                rank, left = rank + taken, left - taken
                add(room, first + took, n - took)
        if left:
            need = -(-left // (capacity // length))
            fill(length, rank, left, capacity, used, need)
            used += need
    return plan


def pack(pieces: DataFrame, by: Sequence[str], capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of at most ``capacity`` as best fit finds.

    ``length`` (1 to ``capacity``) is the size of a piece, ``by`` the columns that order pieces of one length; equal rows are
    interchangeable. All other columns are kept. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per length at most
    histogram = {r["length"]: r["n"] for r in counts}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths have to be from 1 to {capacity}")
    plan = F.broadcast(spark.createDataFrame(best_fit_plan(histogram, capacity), PLAN))
    parts = F.broadcast(
        spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, _parts long")
    )
    dealt = pieces.join(parts, "length").withColumn("_part", F.pmod(F.xxhash64(*by), F.col("_parts"))).drop("_parts")
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = sizes.select("length", "_part", (before - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*by))
    ranked = dealt.withColumn("_place", place).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    here = (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    steps = F.col("_rank") - F.col("rank_from")
    return (
        ranked.join(plan.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & here)
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(_rank - rank_from) div per_sequence"))
        .withColumn("offset", F.col("at") + F.pmod(steps, F.col("per_sequence")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, (sequence_id, ids), from packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most the capacity in tokens
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))


def packed_documents(documents: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """Pieces of all documents with their places: tokenised once, written, then packed."""
    pieces = written(token_pieces(documents, tokenizer, capacity))
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity)
