"""Benchmark decontamination: token windows of the corpus against a hash set of the benchmark's n-grams.

Texts are normalised the same way on both sides: A-Z lower-cased, words are runs of the given characters. A window is ``n``
consecutive words of an item, or the whole item where it has fewer. The distinct windows, keyed by a 64-bit hash, are the
set; every window of every document is hashed and looked up, and the words of a hit are compared before it counts.

All of it is built-in functions. Windows are generated, hashed and looked up inside one code-generated stage: no row of a
window that misses is ever built, and nothing but hits and one row per document is shuffled. The set is measured first; one of
more than ``SET_BYTES`` is dealt into parts of about that size and the documents are scanned once for each, so no broadcast
grows with the benchmark and windows of documents never travel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import written

# Characters that end a word: ASCII but digits and letters.
BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SET_BYTES = 64 << 20  # of the windows in one broadcast, with 64 bytes for each besides its words

_BLANK = "\x1f"  # stands between the words of a window; no word holds it


def words(text: Column, breaks: str = BREAKS) -> Column:
    """The normalised words of a text; null has none."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[^{breaks}]+"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _window(tokens: Column, at: Column, length: int) -> list[Column]:
    return [F.get(tokens, at + k) for k in range(length)]


def _hash(tokens: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *_window(tokens, at, length))


def _by_length(size: Column, lengths: Sequence[int], value: Callable[[int], Column]) -> Column:
    """``value(length)`` for the length that ``size`` holds."""
    chosen = F.when(size == lengths[0], value(lengths[0]))
    for length in lengths[1:]:
        chosen = chosen.when(size == length, value(length))
    return chosen


def item_windows(items: DataFrame, n: int = 10, breaks: str = BREAKS) -> DataFrame:
    """Distinct rows (hash, size, gram, item_id): the windows of every item."""
    tokens = items.select("item_id", words(F.col("text"), breaks).alias("tokens")).where(F.size("tokens") > 0)
    size = F.least(F.size("tokens"), F.lit(n))
    placed = tokens.select(
        "item_id", "tokens", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("tokens") - size)).alias("at")
    )
    lengths = list(range(1, n + 1))
    value = _by_length(F.col("size"), lengths, lambda k: _hash(F.col("tokens"), F.col("at"), k))
    gram = F.array_join(F.slice("tokens", F.col("at") + 1, F.col("size")), _BLANK)
    return placed.select(value.alias("hash"), "size", gram.alias("gram"), "item_id").distinct()


def _beside(base: DataFrame, more: DataFrame, row: Sequence[str]) -> DataFrame:
    """``base``, whose keys are named with an underscore, with the columns of ``more`` where it has the row."""
    same = [base[f"_{c}"].eqNullSafe(more[c]) for c in row]
    return base.join(more, same, "left").drop(*[more[c] for c in row])


def _scan(docs: DataFrame, grams: DataFrame, lengths: Sequence[int], breaks: str, documents: bool) -> DataFrame:
    """Hits of a part of the set that may be broadcast; with ``documents`` also a row for every document."""
    marks = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    tokens = docs.select("doc_id", marks.alias("mark"), words(F.col("text"), breaks).alias("tokens"))
    # The row of position -1 stands for the document itself. The sequence reads the words, so they are made before it runs.
    placed = tokens.select(
        "doc_id", "mark", "tokens", F.size("tokens").alias("n_words"),
        F.explode(F.sequence(F.lit(-1), F.size("tokens") - 1)).alias("at"),
    )
    if len(lengths) > 1:
        placed = placed.select("*", F.explode(F.array(*[F.lit(k) for k in lengths])).alias("size"))
    else:
        placed = placed.withColumn("size", F.lit(lengths[0]))
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n_words"))
    value = _by_length(F.col("size"), lengths, lambda k: _hash(F.col("tokens"), F.col("at"), k))
    placed = placed.withColumn("_hash", F.when(fits, value))
    own = F.array_join(F.slice("tokens", F.col("at") + 1, F.col("size")), _BLANK)
    side = F.broadcast(grams.select(F.col("hash"), F.col("size").alias("_size"), "gram", "gram_id"))
    same = (F.col("_hash") == F.col("hash")) & (F.col("size") == F.col("_size"))
    looked = placed.join(side, same, "left")
    first = F.lit(documents) & (F.col("at") == -1) & (F.col("size") == lengths[0])
    hit = F.col("gram").isNotNull() & (F.when(F.col("gram").isNotNull(), own) == F.col("gram"))
    return looked.where(first | hit).select(
        "doc_id", "mark", "n_words", F.when(~first, F.col("at")).alias("at"), F.when(~first, F.col("size")).alias("size"),
        "gram_id",
    )


def scanned(docs: DataFrame, items: DataFrame, n: int = 10, breaks: str = BREAKS, set_bytes: int = SET_BYTES) -> tuple:
    """(hits, windows): a row per document and one per hit in it, and the items' windows with their number ``gram_id``.

    Hits have doc_id, mark (128 bits of the text's hash), n_words, and at, size, gram_id of a window that occurs (null in
    the document's own row).
    """
    windows = written(item_windows(items, n, breaks))
    grams = windows.select("hash", "size", "gram").distinct()
    grams = written(grams.withColumn("gram_id", F.monotonically_increasing_id()))
    bounds = grams.agg(F.sum(F.octet_length("gram") + 64), F.sort_array(F.collect_set("size"))).first()
    parts = max(1, -(-(bounds[0] or 0) // set_bytes))
    lengths = bounds[1] or [n]
    scans = []
    for part in range(parts):
        side = grams if parts == 1 else grams.where(F.pmod(F.xxhash64("gram_id"), F.lit(parts)) == part)
        scans.append(_scan(docs, side, lengths, breaks, part == 0))
    kept = reduce(DataFrame.unionByName, scans)
    return kept, windows.join(grams.select("gram", "gram_id"), "gram").select("gram_id", "item_id")


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, breaks: str = BREAKS, set_bytes: int = SET_BYTES) -> DataFrame:
    """Per document row: doc_id, mark, n_words, n_hit (words inside a window that occurs), n_items, item_ids, spans.

    ``items`` has item_id and text. ``item_ids`` are the distinct ids, as strings in ascending order, of the items that have a
    window in the document; an item without an id hits but is not listed. ``spans`` are the hit words as maximal (start,
    stop) runs, stop excluded, in order. A null or empty text has no words and no hits, and neither has an item without
    words. Texts of any length are scanned whole. Rows that are equal in doc_id and text have equal results and are all
    returned; rows that share a doc_id, or have none, are told apart by their text. Other columns play no part. No documents
    give no rows; no items give no hits.
    """
    hits, windows = scanned(docs, items, n, breaks, set_bytes)
    hits = written(hits)
    row = ["doc_id", "mark"]
    base = hits.where("at is null").groupBy(*row, "n_words").agg(F.count(F.lit(1)).alias("copies"))
    base = base.select(*[F.col(c).alias(f"_{c}") for c in row], "n_words", "copies")
    found = hits.where("at is not null")
    reach = found.groupBy(*row, "at").agg(F.max(F.col("at") + F.col("size")).alias("stop"))
    before = Window.partitionBy(*row).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = reach.withColumn("_upto", F.max("stop").over(before))
    opens = F.col("_upto").isNull() | (F.col("at") > F.col("_upto"))
    order = Window.partitionBy(*row).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = upto.withColumn("_run", F.sum(opens.cast("int")).over(order))
    runs = runs.groupBy(*row, "_run").agg(F.min("at").alias("start"), F.max("stop").alias("stop"))
    spans = runs.groupBy(*row).agg(
        F.sum(F.col("stop") - F.col("start")).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"),
    )
    owners = windows.where("item_id is not null").select("gram_id", "item_id").distinct()
    pairs = found.select(*row, "gram_id").distinct().join(owners, "gram_id").select(*row, "item_id").distinct()
    listed = pairs.groupBy(*row).agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    both = _beside(_beside(base, spans, row), listed, row)
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return both.select(
        F.col("_doc_id").alias("doc_id"), F.col("_mark").alias("mark"), F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(item_ids).cast("bigint").alias("n_items"), item_ids.alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"), copies.alias("_copy"),
    ).drop("_copy")


def decontaminated(
    docs: DataFrame, items: DataFrame, remove: str = "spans", n: int = 10, breaks: str = BREAKS, set_bytes: int = SET_BYTES
) -> DataFrame:
    """``docs`` with all their columns, without the documents that hold a benchmark window or without the words of them.

    ``remove`` is ``documents`` or ``spans``. A span goes with the characters between its words and before the first; what
    is left keeps its spelling. Documents without a hit stay as they are, also those without a text. See ``contamination``
    for nulls, repeated rows and empty tables.
    """
    found = contamination(docs, items, n, breaks, set_bytes).where("n_hit > 0")
    found = written(found.groupBy("doc_id", "mark").agg(F.min("spans").alias("_spans")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("_mark"))
    same = keyed["_row.doc_id"].eqNullSafe(found["doc_id"]) & (keyed["_mark"] == found["mark"])
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select("_row.*")
    text = F.col("_row.text")
    pieces = F.regexp_extract_all(text, F.lit(f"[{breaks}]*+[^{breaks}]++"), F.lit(0))
    hit = lambda at: F.exists("_spans", lambda s: (at >= s["start"]) & (at < s["stop"]))
    left = F.array_join(F.filter(pieces, lambda piece, at: ~hit(at)), "")
    cut = F.concat(left, F.regexp_extract(text, f"[{breaks}]*$", 0))
    text = F.when(F.col("_spans").isNull(), text).otherwise(cut)
    joined = keyed.join(found, same, "left").withColumn("_row", F.col("_row").withField("text", text))
    return joined.select("_row.*")
