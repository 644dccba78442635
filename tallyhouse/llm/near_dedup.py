"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Every document becomes the set of its distinct word shingles. Two permutations make all signature coordinates: the first
scrambles the shingles, the second, shifted circularly by k, gives coordinate k. Bands of ``ROWS`` coordinates put
documents into buckets; the number of bands follows from the threshold, so that a pair at the threshold is missed with a
probability below ``MISS``.

Documents with equal sets form one class before banding. A bucket never emits all its pairs: its members are compared with
one of them, the pivot, chosen as the member with most company over all its buckets, so that a large group of near copies
costs one comparison per member. Two members x and y that the pivot p does not connect are then looked for by what sets them
apart from p: were they linked, their differences from p would largely agree, so a short prefix of the ordered difference
sets has to meet in an inverted index (prefix and position filter of set similarity joins; exact). No bucket is capped and
links are decided on full sets only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import ascii_words, components, pieces_of, splitmix, text_bytes, written

ROWS = 4
MISS = 1e-9


def bands_for(percent: int) -> int:
    """Bands needed so that a pair at the threshold shares no bucket with a probability below ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, without words none."""
    data, offsets = text_bytes(texts)
    hashes, counts = ascii_words(data, offsets)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for i in range(words):
        rolled = splitmix(rolled + hashes[i : i + len(rolled)] + np.uint64(words))
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if count >= words:
            own = np.sort(rolled[end - count : end - words + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif count:
            one = np.zeros(1, np.uint64)
            for h in hashes[end - count : end]:
                one = splitmix(one + h + np.uint64(count))
            yield one
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash over 32-bit ids: coordinate k is the least second-permutation value of (first permutation + k)."""
    first = (splitmix(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 1024):
        z = first[None, at : at + 1024] + shifts
        z ^= z >> np.uint32(16)
        z *= np.uint32(0x85EBCA6B)
        z ^= z >> np.uint32(13)
        z *= np.uint32(0xC2B2AE35)
        z ^= z >> np.uint32(16)
        np.minimum(best, z.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i] + np.uint64(1))
    return key.view(np.int64)


def signatures(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, bands): the set's size, a 128-bit name of the set, one bucket per band."""
    size = bands_for(percent) * ROWS
    schema = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                counts, keys, bands = [], [], []
                for own in shingle_sets(batch.column("text"), words):
                    counts.append(len(own))
                    if len(own):
                        digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                        keys.append(np.frombuffer(digest, np.int64))
                        bands.append(band_keys(signature(own, size)))
                    else:
                        keys.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array([k if k is None else int(k[0]) for k in keys], pa.int64()),
                        pa.array([k if k is None else int(k[1]) for k in keys], pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "bands"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def sets_of(documents: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of every document with words, for verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                own = [s.view(np.int64) for s in shingle_sets(batch.column("text"), words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(own, pa.list_(pa.int64()))], names=["node", "shingles"]
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, shingles array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int, with_rest: bool = False) -> DataFrame:
    """(a, b, common, n_a, n_b) for pairs of nodes, from their full sets; with ``rest``, what sets a apart from b.

    ``rest`` lists the differences in one order for all nodes, additions before removals, as far as the prefix filter needs.
    """
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    # The most that two linked sets of which one has n elements can differ by.
    reach = (100 - percent) / percent
    schema = "a long, b long, common long, n_a long, n_b long" + ", rest array<long>" * with_rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("of_a"), batch.column("of_b")
            common, rest, n_a, n_b = [], [], [], []
            for i in range(batch.num_rows):
                x, y = one[i].values.to_numpy(), two[i].values.to_numpy()
                merged = np.concatenate([x, y])
                merged.sort()
                common.append(int(np.count_nonzero(merged[1:] == merged[:-1])))
                n_a.append(len(x))
                n_b.append(len(y))
                if with_rest:
                    added = np.sort(np.setdiff1d(x, y, assume_unique=True))
                    gone = np.sort(np.setdiff1d(y, x, assume_unique=True)) ^ np.int64(0x5555555555555555)
                    rest.append(np.concatenate([added, gone])[: int(reach * len(x)) + 1])
            columns = [batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in (common, n_a, n_b))]
            names = ["a", "b", "common", "n_a", "n_b"]
            if with_rest:
                columns.append(pa.array(rest, pa.list_(pa.int64())))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, schema)


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``100 * intersection >= percent * union`` over their sets of ``words``-word shingles;
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` tells whether that is the document itself.
    Null, empty or blank texts have no shingles and are linked with nothing. A null doc_id is linked with nothing, its
    component_id is null and it is kept. Rows that repeat a doc_id are one node of the graph and each give a row. Other
    columns are ignored; an empty table gives no rows.
    """
    signed = written(signatures(documents, words, percent))
    live = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(
        live.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    )
    exploded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = written(exploded.join(shared, "bucket").select("bucket", "node", "size").distinct())

    # A doc_id that stands for several sets is one node.
    key = [F.col("key_a"), F.col("key_b")]
    named = live.select("doc_id", *key).join(classes.select("node", *key), ["key_a", "key_b"])
    twice = named.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")
    links = twice.select("a", "b")

    wanted = crowded.select(F.col("node").alias("doc_id")).distinct()
    of_wanted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    once = of_wanted.groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    once = once.select("doc_id", F.explode("texts").alias("text"))
    sets = written(sets_of(once, words))
    group = written(_settled(crowded, sets, links, percent))

    found = named.join(group.withColumnRenamed("component", "grouped"), "node", "left")
    found = found.select("doc_id", *key, F.coalesce("grouped", "node").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", *key).join(
        found.distinct(), ["doc_id", "key_a", "key_b"], "left"
    )
    rows = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _settled(crowded: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    company = crowded.groupBy("node").agg(F.sum("size").alias("company"))
    pivots = crowded.join(company, "node").groupBy("bucket").agg(
        F.max_by("node", F.struct("company", -F.col("node"))).alias("pivot")
    )
    pairs = crowded.join(pivots, "bucket").where("node <> pivot")
    pairs = pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = written(compared(pairs, sets, percent, with_rest=True))
    first = written(components(links.unionByName(near.where(_linked(percent)).select("a", "b"))))

    rest = written(compared(_left_over(near, first, percent), sets, percent)).where(_linked(percent)).select("a", "b")
    for end in ("a", "b"):
        named = first.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        rest = rest.join(named, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    second = components(rest.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    second = written(second.select(F.col("node").alias("component"), F.col("component").alias("joined")))
    old = first.join(second, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    alone = second.select(F.col("component").alias("node"), F.col("joined").alias("component"))
    return old.unionByName(alone.join(first.select("node"), "node", "left_anti"))


def _left_over(near: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one pivot, in different components, whose differences from the pivot could agree enough.

    With D_x the number of differences of x from the pivot and T the most that two linked sets of these sizes differ by,
    linked x and y share at least (D_x + D_y - T) / 2 differences; sharing none would make both linked to the pivot. So the
    prefixes that leave out all but that many less one share an element, at a place within both prefixes.
    """
    spread = (100 - percent) / (100 + percent)
    members = near
    for end in ("a", "b"):
        named = group.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        members = members.join(named, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    members = written(members)
    mixed = members.where("c_a <> c_b").select("b").distinct()
    listed = members.join(mixed, "b").select(
        "b", F.col("a").alias("x"), F.col("c_a").alias("c"), F.col("n_a").alias("n"),
        (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("d"), F.posexplode("rest").alias("pos", "element"),
    )
    half = (100 - percent) / percent / 2
    one = listed.select("b", "element", *[F.col(c).alias(f"{c}1") for c in ("x", "c", "n", "d", "pos")])
    two = listed.where(F.col("pos") <= half * F.col("n") + 1).select(
        "b", "element", *[F.col(c).alias(f"{c}2") for c in ("x", "c", "n", "d", "pos")]
    )
    needed = (F.col("d1") + F.col("d2") - spread * (F.col("n1") + F.col("n2"))) / 2 - 1e-6
    ordered = (F.col("d1") > F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("x1") > F.col("x2")))
    fits = (F.col("pos1") <= F.col("d1") - needed) & (F.col("pos2") <= F.col("d2") - needed) & (needed <= F.col("d2"))
    sized = F.least("n1", "n2") * 100 >= percent * F.greatest("n1", "n2")
    met = one.join(two, ["b", "element"]).where((F.col("c1") != F.col("c2")) & ordered & fits & sized)
    return met.select(F.greatest("x1", "x2").alias("a"), F.least("x1", "x2").alias("b")).distinct()


def _linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
