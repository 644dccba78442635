"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

Texts are taken in blocks, each of many Arrow batches where texts are short. A block's distinct n-grams with their counts go, by ranges of their 56-bit hash, to the
partitions of the count table; a frequent n-gram is one entry per block. There the entries of all blocks are summed, and
every block gets the corpus counts of its own n-grams back: the join of the count table with the exploded n-grams, with
sorted arrays instead of one row per n-gram. The block then looks up each n-gram of its documents and sums per document.

Counts are held out: what a document counted itself is taken off before it is scored, so a phrase that no other document
has is backed off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import ascii_words, pieces_of, splitmix, text_bytes

BLOCK = 8 << 20  # bytes of text in a block, or one longer text
HASHED = 1 << 20  # bytes hashed at a time
ENTRIES = 1 << 23  # bytes of text per partition of the count table
BACKOFF = 0.4
BITS = 56
WORD = r"[^\x20\x09-\x0D]+"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), end to end, and the number of words of each text."""
    hashes, counts = [], []
    for batch in pieces_of(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", HASHED):
        own, n = ascii_words(*text_bytes(batch.column("text")))
        hashes.append(own)
        counts.append(n)
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(counts or [np.zeros(0, np.int64)])


def ngrams(words: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each word; 0 where the document has too few words before it."""
    ends = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(words)) - ends
    rolled, out = np.zeros(len(words), np.uint64), []
    for n in range(1, order + 1):
        rolled = splitmix(np.concatenate([np.zeros(min(1, len(words)), np.uint64), rolled[:-1]]) + words + np.uint64(n))
        own = (rolled >> np.uint64(64 - BITS)) | np.uint64(1)
        out.append(np.where(place >= n - 1, own, np.uint64(0)))
    return out


def _pack(values: np.ndarray) -> bytes:
    """Sorted values: how many, the first, and the differences by bytes, in as few as the largest needs.

    The lower bytes of differences of hashes are random and stay as they are; the highest one is compressed.
    """
    steps = np.diff(values).astype("<u8")
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    head = np.array([len(values), values[0] if len(values) else 0], "<u8").tobytes() + bytes([width])
    return head + planes[:-1].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes[-1].tobytes())


def _unpack(data: bytes) -> np.ndarray:
    n, first = (int(x) for x in np.frombuffer(data, "<u8", 2))
    if not n:
        return np.zeros(0, np.uint64)
    low, start = (data[16] - 1) * (n - 1), 17
    steps = np.zeros((n, 8), np.uint8)
    steps[1:, : data[16] - 1] = np.frombuffer(data, np.uint8, low, start).reshape(-1, n - 1).T if low else 0
    steps[1:, data[16] - 1] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[start + low :]), np.uint8)
    values = steps.view("<u8").ravel()
    values[0] = first
    return np.cumsum(values, dtype=np.uint64)


_TEXTS = pa.schema([("text", pa.string())])


def _squeeze_texts(texts: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays([texts.cast(pa.string())])], schema=_TEXTS)
    return zstandard.ZstdCompressor(level=3).compress(batch.serialize())


def _unsqueeze_texts(data: bytes) -> pa.Array:
    return pa.ipc.read_record_batch(pa.py_buffer(zstandard.ZstdDecompressor().decompress(data)), _TEXTS).column("text")


def _squeeze(counts: np.ndarray) -> bytes:
    planes = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _block_name(doc_ids: list, texts: pa.Array) -> int:
    """A name that the block gets again whenever it is read again."""
    data, offsets = text_bytes(texts)
    digest = hashlib.blake2b(repr(doc_ids).encode(), digest_size=8)
    digest.update(offsets.tobytes())
    digest.update(data)
    return int.from_bytes(digest.digest(), "little", signed=True)


def _distinct(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate(ngrams(*word_hashes(texts), order))
    return np.unique(grams[grams > 0], return_counts=True)


def scored(documents: DataFrame, order: int = 3, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, n_backed_off, log_score) of every document row.

    The score of a word is the held-out count of the longest n-gram (up to ``order`` words, within the document) over that of
    its context, times ``backoff`` for every shorter step; a word that no other document has counts as ``backoff`` times one
    in all words of the corpus. ``log_score`` sums natural logarithms; ``n_backed_off`` counts words not scored at the
    longest order their place allows. Null, empty and blank texts have 0 words and log_score 0. Repeated rows count and are
    scored each for itself; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(WORD)).cast("long"))).first()
    n_parts, n_words = max(1, -(-int(total[0] or 0) // ENTRIES)), int(total[1] or 0)
    step = np.uint64(-(-(1 << BITS) // n_parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, doc_ids in _blocks(batches):
            name = _block_name(doc_ids, texts)
            grams, counts = _distinct(texts, order)
            cuts = np.searchsorted(grams // step, np.arange(n_parts + 1, dtype=np.uint64))
            rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _, _ in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()),
                    pa.array([_pack(grams[a:b]) for _, a, b in rows], pa.binary()),
                    pa.array([_squeeze(counts[a:b]) for _, a, b in rows], pa.binary()),
                ],
                names=["part", "block", "grams", "counts"],
            )

    def count(own: pa.Table) -> pa.Table:
        grams = [_unpack(x) for x in own.column("grams").to_pylist()]
        counts = [_unsqueeze(x) for x in own.column("counts").to_pylist()]
        every, place = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, place, np.concatenate(counts))
        ends = np.cumsum([len(g) for g in grams])
        found = [_squeeze(sums[place[e - len(g) : e]]) for g, e in zip(grams, ends, strict=True)]
        return pa.table({"block": own.column("block"), "part": own.column("part"), "counts": pa.array(found, pa.binary())})

    asked = docs.mapInArrow(ask, "part int, block long, grams binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(count, "block long, part int, counts binary")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, doc_ids in _blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([_block_name(doc_ids, texts)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([_squeeze_texts(texts)], pa.binary())],
                names=["block", "doc_ids", "texts"],
            )

    def score(own: pa.Table, answered: pa.Table) -> pa.Table:
        told = dict(zip(answered.column("part").to_pylist(), answered.column("counts").to_pylist(), strict=True))
        out = {"doc_id": [], "n_words": [], "n_backed_off": [], "log_score": []}
        for doc_ids, texts in zip(own.column("doc_ids").to_pylist(), own.column("texts").to_pylist(), strict=True):
            found = [_unsqueeze(told[p]) for p in sorted(told)]
            sums = np.concatenate(found or [np.zeros(0, np.int64)])
            sizes, missed, scores = _block_scores(_unsqueeze_texts(texts), sums, order, backoff, n_words)
            for name, values in zip(out, (doc_ids, sizes.tolist(), missed.tolist(), scores.tolist()), strict=True):
                out[name].extend(values)
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("log_score", pa.float64())]))

    sent = docs.mapInArrow(send, "block long, doc_ids array<long>, texts binary")
    return sent.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, n_backed_off long, log_score double"
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    texts, doc_ids, size = [], [], 0
    for whole in batches:
        for batch in pieces_of(whole, "text", BLOCK):
            own = batch.column("text")
            n = pc.sum(pc.binary_length(own)).as_py() or 0
            if texts and size + n > BLOCK:
                yield pa.concat_arrays(texts), doc_ids
                texts, doc_ids, size = [], [], 0
            texts.append(own)
            doc_ids = doc_ids + batch.column("doc_id").to_pylist()
            size += n
    if texts:
        yield pa.concat_arrays(texts), doc_ids


def _block_scores(
    texts: pa.Array, sums: np.ndarray, order: int, backoff: float, n_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, backed-off words and summed logarithms of each text; ``sums`` are the corpus counts of the block's n-grams."""
    words, counts = word_hashes(texts)
    grams = ngrams(words, counts, order)
    every = np.unique(np.concatenate(grams))
    every = every[every > 0]
    if len(every) != len(sums):
        raise RuntimeError("the documents were not read alike twice; write them as a table first")
    doc = np.repeat(np.arange(len(counts)), counts)
    # Held-out count of the n-gram that ends at each word, by order; -1 where there is none.
    held = []
    for own in grams:
        there = own > 0
        at = np.searchsorted(every, own[there])
        pair, back, times = np.unique(doc[there] * len(every) + at, return_inverse=True, return_counts=True)
        left = np.full(len(own), -1, np.int64)
        left[there] = sums[at] - times[back]
        held.append(left)
    score = np.zeros(len(words))
    todo = np.ones(len(words), bool)
    longest = np.zeros(len(words), np.int64)
    for n, left in enumerate(held):
        longest[left >= 0] = n
    steps = np.zeros(len(words))
    missed = np.zeros(len(words), bool)
    others = n_words - counts[doc]
    for n in range(order - 1, -1, -1):
        there = todo & (held[n] >= 0)
        if n:
            context = np.concatenate([[-1], held[n - 1][:-1]]) if len(words) else held[n - 1]
        else:
            context = others
        hit = there & (held[n] > 0) & (context > 0)
        score[hit] = np.log(held[n][hit] / context[hit]) + steps[hit] * np.log(backoff)
        todo &= ~hit
        missed |= hit & (longest > n)
        steps[there & ~hit] += 1
    missed |= todo
    score[todo] = steps[todo] * np.log(backoff) - np.log(max(1, n_words))
    return counts, np.bincount(doc, missed, len(counts)).astype(np.int64), np.bincount(doc, score, len(counts))
