"""Removal of repeated passages: every byte covered by a string of ``length`` bytes that also starts somewhere else.

Work is dealt out by content. Each window of ``length`` bytes is known by the least hash of the short strings inside it, so
equal windows, wherever they start, belong to the same hash. Neighbouring windows of one hash form a run; a run and the
bytes its last window reaches is a piece, and every window of the corpus is in exactly one piece. Hashes seen in one piece
only, and once in it, can hold no repeat. Equal pieces are counted and become one. What is left goes, by hash, to shards;
each shard orders all its suffixes and finds the windows with a common prefix of ``length`` bytes (``induced_sort``).

A hash whose pieces hold more than a shard (a line that stands in very many surroundings) is not sorted: its pieces are cut
again by the least hash of longer strings, which reach beyond the line, and so on. The longest string is the window itself;
there equal hashes are the repeats and nothing is left to sort.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import handing_back, pieces_of, powers, splitmix, text_bytes, written
from tallyhouse.llm.induced_sort import repeated_starts

SHORT = 32  # bytes of the short strings
SHARD = 2 << 20  # bytes of pieces in a shard, about; those of one hash are at most this

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_NOTHING = hashlib.sha256(b"").hexdigest()


def window_runs(data: np.ndarray, length: int, short: int = SHORT) -> list[np.ndarray]:
    """Runs of windows with the same least hash: hash, hash of the piece, first window, number of windows, and whether the
    least short string occurs more than once in the piece."""
    n, short = len(data), min(short, length)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n, _BASE), out=sums[1:])
    inverse = powers(n, _INVERSE)
    hashes = splitmix((sums[short:] - sums[: n - short + 1]) * inverse[: n - short + 1])
    wide = length - short + 1  # short strings of a window
    padded = np.full(-(-len(hashes) // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    padded[: len(hashes)] = hashes
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n_windows = n - length + 1
    least = np.minimum(behind[:n_windows], ahead[wide - 1 : wide - 1 + n_windows])
    first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    count = np.diff(np.append(first, n_windows))
    own = least[first]
    piece = splitmix((sums[first + count - 1 + length] - sums[first]) * inverse[first] + count.astype(np.uint64))
    again = [
        np.count_nonzero(hashes[a : a + c + wide - 1] == h) > 1
        for a, c, h in zip(first.tolist(), count.tolist(), own, strict=True)
    ]
    return [own.view(np.int64), piece.view(np.int64), first.astype(np.int32), count.astype(np.int32), np.array(again)]


def _scanned(named: DataFrame, length: int) -> DataFrame:
    """(doc_id, sha, n_bytes, runs) of every row; texts of fewer than ``length`` bytes have no runs."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["h", "piece", "first", "n", "again"]
    schema = "doc_id long, sha string, n_bytes long, h array<long>, piece array<long>, first array<int>, n array<int>, again array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                found = [
                    window_runs(data[a:b], length) if b - a >= length else [[]] * 5
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]
                columns = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("sha"), pa.array(np.diff(offsets), pa.int64()), *columns],
                    names=["doc_id", "sha", "n_bytes", *names],
                )

    return named.mapInArrow(handing_back(run), schema)


def _named(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))


def _cut_out(wanted: DataFrame) -> DataFrame:
    """(h, piece, bytes) from (text, parts): the pieces that stand for all their equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                hashes, pieces, contents = [], [], []
                for start, parts in zip(offsets.tolist(), batch.column("parts").to_pylist(), strict=False):
                    for p in parts:
                        hashes.append(p["h"])
                        pieces.append(p["piece"])
                        contents.append(data[start + p["first"] : start + p["first"] + p["size"]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes, pa.int64()), pa.array(pieces, pa.int64()), pa.array(contents, pa.binary())],
                    names=["h", "piece", "bytes"],
                )

    return wanted.select("text", "parts").mapInArrow(handing_back(run), "h long, piece long, bytes binary")


def _cut_again(wanted: DataFrame, length: int, short: int) -> DataFrame:
    """The pieces in (sha, text, parts) cut by the least hash of strings of ``short`` bytes: (h, piece) of the whole, where
    the part starts in it (at) and in the text (first), and what ``window_runs`` gives for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                texts = zip(offsets.tolist(), batch.column("sha").to_pylist(), batch.column("parts").to_pylist(), strict=False)
                for start, sha, parts in texts:
                    found = [window_runs(data[start + p["first"] : start + p["first"] + p["size"]], length, short) for p in parts]
                    key, kind, at, n, again = (np.concatenate([f[i] for f in found]) for i in range(5))
                    of = np.repeat(np.arange(len(parts)), [len(f[0]) for f in found])
                    h, piece, first = (np.array([p[c] for p in parts], np.int64)[of] for c in ("h", "piece", "first"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h), pa.array(piece), pa.array([sha] * len(of), pa.string()), pa.array(at),
                            pa.array(at + first.astype(np.int32)), pa.array(key), pa.array(kind), pa.array(n), pa.array(again),
                        ],
                        names=["h", "piece", "sha", "at", "first", "key", "kind", "n", "again"],
                    )

    return wanted.select("sha", "text", "parts").mapInArrow(
        handing_back(run), "h long, piece long, sha string, at int, first int, key long, kind long, n int, again boolean"
    )


def _sorted_shards(pieces: DataFrame, length: int, n_shards: int) -> DataFrame:
    """(h, piece, ranges): the windows of each piece, as ranges from and to, that start elsewhere in the shard too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names, texts = [], [], []
        for batch in batches:
            hashes += batch.column("h").to_pylist()
            names += batch.column("piece").to_pylist()
            texts += batch.column("bytes").to_pylist()
        if not texts:
            return
        starts = repeated_starts(texts, length)
        if not len(starts):
            return
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        of = np.searchsorted(begins, starts, "right") - 1
        edge = np.flatnonzero((np.diff(starts, prepend=-2) != 1) | (np.diff(of, prepend=-1) != 0))
        last = np.append(edge[1:], len(starts)) - 1
        rows: dict[int, list] = {}
        for k, a, b in zip(of[edge].tolist(), starts[edge].tolist(), starts[last].tolist(), strict=True):
            rows.setdefault(k, []).append([a - int(begins[k]), b - int(begins[k])])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([hashes[k] for k in rows], pa.int64()), pa.array([names[k] for k in rows], pa.int64()),
                pa.array(list(rows.values()), pa.list_(pa.list_(pa.int32()))),
            ],
            names=["h", "piece", "ranges"],
        )

    return pieces.repartition(n_shards, "h").mapInArrow(handing_back(run), "h long, piece long, ranges array<array<int>>")


def _found(once: DataFrame, chosen: DataFrame, length: int, short: int) -> DataFrame:
    """(h, piece, ranges): the windows of each piece, as ranges from and to, that start in another place of a piece of its h.

    ``chosen`` has different pieces (h, piece, sha, first, size) and the bytes of all pieces of the h; it is cut by strings
    of ``short`` bytes.
    """

    def parts(of: DataFrame) -> DataFrame:
        listed = of.groupBy("sha").agg(F.collect_list(F.struct("h", "piece", "first", "size")).alias("parts"))
        return once.join(listed, "sha")

    hot = F.col("bytes") > SHARD
    small, n_hot = chosen.agg(F.sum(F.when(~hot, F.col("size"))), F.count_if(hot)).first()
    n_shards = max(1, math.ceil((small or 0) / SHARD))
    found = written(_sorted_shards(_cut_out(parts(chosen.where(~hot))), length, n_shards))
    if not n_hot:
        return found

    short = length - (length - short) // 4
    cut = written(_cut_again(parts(chosen.where(hot)), length, short))
    whole = F.array(F.array(F.lit(0), F.col("n") - 1))
    if short == length:  # a key is one window
        equal = cut.groupBy("h", "key").agg(F.sum("n").alias("times")).where("times > 1")
        told = cut.join(equal, ["h", "key"], "left_semi").withColumn("ranges", whole)
    else:
        kinds = _kinds(cut.withColumn("copies", F.lit(1)), ["h", "key"], "kind", length)
        inner = kinds.where("sorted").select(
            F.xxhash64("h", "key").alias("h"), F.col("kind").alias("piece"), "chosen.sha", "chosen.first",
            (F.col("chosen.n") + (length - 1)).alias("size"), "bytes",
        )
        inner = _found(once, inner, length, short).select(
            F.col("h").alias("mixed"), F.col("piece").alias("kind"), "ranges"
        )
        told = cut.join(kinds.select("h", "key", "kind", "times"), ["h", "key", "kind"])
        told = told.withColumn("mixed", F.xxhash64("h", "key")).join(inner, ["mixed", "kind"], "left")
        told = told.withColumn("ranges", F.when(F.col("times") > 1, whole).otherwise(F.col("ranges")))
    moved = F.transform("ranges", lambda r: F.transform(r, lambda x: x + F.col("at")))
    told = told.where("ranges is not null").select("h", "piece", moved.alias("ranges"))
    told = told.groupBy("h", "piece").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))  # bounded by the piece
    return written(found.unionByName(told))


def _kinds(runs: DataFrame, key: list[str], piece: str, length: int) -> DataFrame:
    """Different pieces that may hold repeats: how often each occurs, whether it has to be sorted, where it stands, and the
    bytes of all different pieces of its key."""
    kinds = runs.groupBy(*key, piece).agg(
        F.sum("copies").alias("times"), F.max("again").alias("again"), F.max("n").alias("n"),  # n is part of the name
        # Of the places of a piece one stands for all; a text without copies, if there is one.
        F.min(F.struct(F.col("copies") > 1, "sha", "first", "n")).alias("chosen"),
    )
    pieces = kinds.groupBy(*key).agg(
        F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") + (length - 1)).cast("long")).alias("bytes")
    )
    kinds = kinds.join(pieces, key).withColumn("sorted", (F.col("kinds") > 1) | F.col("again"))
    kinds = kinds.where((F.col("times") > 1) | F.col("sorted"))
    return written(kinds.select(*key, piece, "times", "sorted", "chosen", "bytes"))


def _without(marked: DataFrame, length: int) -> DataFrame:
    """(sha, n_removed, n_spans, kept_sha256, kept) from (sha, text, ranges of windows that repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                removed, spans, shas, kept = [], [], [], []
                for a, b, ranges in zip(offsets[:-1], offsets[1:], batch.column("ranges").to_pylist(), strict=True):
                    edge = np.zeros(b - a + 1, np.int32)
                    for first, last in ranges:
                        edge[first] += 1
                        edge[last + length] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    rest = data[a:b][~gone].tobytes()
                    removed.append(int(gone.sum()))
                    spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                    shas.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sha"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())],
                    names=["sha", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return marked.select("sha", "text", "ranges").mapInArrow(
        handing_back(run), "sha string, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _cuts(documents: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its text's name and size, and what is cut from the texts that lose something."""
    named = _named(documents)
    rows = written(_scanned(named, length))
    texts = rows.where(F.col("n_bytes") >= length).groupBy("sha").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n_bytes", "h", "piece", "first", "n", "again")]
    )
    texts = written(texts)
    zipped = F.explode(F.arrays_zip("h", "piece", "first", "n", "again")).alias("r")
    runs = texts.select("sha", "copies", zipped).select("sha", "copies", "r.*")
    kinds = _kinds(runs, ["h"], "piece", length)
    suspects = written(
        runs.where("copies = 1").join(kinds.select("h", "piece", "times"), ["h", "piece"]).select(
            "sha", "h", "piece", "first", "n", "times"
        )
    )
    chosen = kinds.where("sorted").select(
        "h", "piece", "chosen.sha", "chosen.first", (F.col("chosen.n") + (length - 1)).alias("size"), "bytes"
    )
    needed = suspects.select("sha").unionByName(chosen.select("sha")).distinct()
    once = named.select("sha", "text").join(needed, "sha", "left_semi").groupBy("sha").agg(F.first("text").alias("text"))
    once = written(once)
    found = _found(once, chosen, length, min(SHORT, length))

    whole = F.array(F.array(F.lit(0), F.col("n") - 1))
    told = suspects.join(found, ["h", "piece"], "left").withColumn(
        "ranges", F.when(F.col("times") > 1, whole).otherwise(F.col("ranges"))
    )
    moved = F.transform("ranges", lambda r: F.transform(r, lambda x: x + F.col("first")))
    marks = told.where("ranges is not null").select("sha", moved.alias("ranges"))
    marks = marks.groupBy("sha").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))  # bounded by the text
    cut = _without(once.join(marks, "sha"), length)
    copied = texts.where("copies > 1").select(
        "sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(_NOTHING).alias("kept_sha256"), F.lit(b"").alias("kept"),
    )
    return rows, cut.unionByName(copied)


def removed_repeats(documents: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document row.

    Texts are UTF-8 bytes; null counts as empty. A byte goes when a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another; all are judged on the input. Strings never cross texts. Rows with the same
    text, also with the same doc_id, are repeats of each other. Other columns are ignored; an empty table gives no rows.
    """
    rows, cut = _cuts(documents, length)
    out = rows.select("doc_id", "sha", "n_bytes").join(cut.drop("kept"), "sha", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, length: int = 400) -> DataFrame:
    """``documents`` with the repeated bytes taken out of ``text``; ``n_chars``, if there, follows.

    Where a cut falls inside a character, the bytes of it that are left over go too. A text that loses nothing stays as it
    is, null included.
    """
    _, cut = _cuts(documents, length)
    kept = cut.select("sha", _decoded(F.col("kept")).alias("kept"))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    met = documents.select(row, F.sha2("text", 256).alias("sha")).join(kept, "sha", "left")
    text = F.coalesce("kept", F.col("row.text"))
    kinds = dict(documents.dtypes)

    def column(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            return F.when(F.col("kept").isNull(), F.col("row")[c]).otherwise(F.length("kept").cast(kinds[c])).alias(c)
        return F.col("row")[c].alias(c)

    return met.select(*[column(c) for c in documents.columns])


def _decoded(content: Column) -> Column:
    @F.udf("string", useArrow=True)
    def decode(x: bytes) -> str | None:
        return None if x is None else bytes(x).decode("utf-8", "ignore")

    return decode(content)
