"""The pipeline stage by stage on the small tables and on odd rows."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest

from llm.conftest import ODD, SF, documents
from llm.test_texts import near_brute, repeats_brute, words
from tallyhouse.llm.common import handing_back


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        out.append((name, docs, rows))
        docs = spark.createDataFrame(rows.collect(), rows.schema)
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "best_fit_packing"]
    for _, docs, rows in stages[:-1]:
        assert rows.columns == docs.columns


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    _, docs, rows = stages[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows.collect()}
    gone = {r.doc_id for r in docs.collect()} - kept
    assert not [i for i in gone if labels.get(i) == 0]


def test_one_document_of_each_group_stays(stages):
    _, docs, rows = stages[1]
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    keep = sorted(i for i, _, _, kept in near_brute(before, 5, 80) if kept)
    assert sorted(r.doc_id for r in rows.collect()) == keep


def test_repeats_go(stages):
    _, docs, rows = stages[2]
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = {i: n - gone for i, n, gone, _, _ in repeats_brute(before, corpus_pipeline.REPEAT_BYTES)}
    for r in rows.collect():
        assert abs(len((r.text or "").encode()) - want[r.doc_id]) <= 6


def test_mix_and_packing(stages):
    _, docs, rows = stages[3]
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    taken = Counter()
    for r in rows.collect():
        taken[r.doc_id] += len(words(r.text))
    assert all(n <= 2 * size[i] for i, n in taken.items())
    assert 1.3 * sum(size.values()) <= sum(taken.values()) <= 1.7 * sum(size.values())
    packed = stages[4][2].collect()
    assert sum(r.piece == 0 for r in packed) == rows.count()


def test_odd_rows_go_through(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, SF)
            docs = spark.createDataFrame(rows.collect(), rows.schema)
        assert docs.columns[:2] == ["doc_id", "piece"]
    assert len(ODD) > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_passages_of_over_fifty_words_go(spark):
    """A passage of 51 words that two clean texts share goes from both, whatever stands around it."""
    rng = random.Random(51)
    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))

    for _ in range(3):
        passage, own = prose(51), [prose(60) for _ in range(4)]
        rows = [(1, f"{own[0]} {passage} {own[1]}", "a"), (2, f"{own[2]} {passage}. {own[3]}", "b"), (3, prose(200), "a")]
        got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, documents(spark, rows), SF).collect()}
        assert got[3] == rows[2][1]
        for i, (before, after) in ((1, own[:2]), (2, own[2:])):
            assert got[i].startswith(before[:-1]) and got[i].endswith(after)
            assert len(got[i]) <= len(before) + len(after) + 3


def test_workers_hand_back_what_they_have_freed():
    """Freed blocks below a kept one stay with a process until they are handed back."""

    def resident() -> int:
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    sizes = []

    def run(batches):
        blocks = [b"x" * 100_000 for _ in range(2_000)]
        kept.append(blocks.pop())
        sizes.append(resident())
        yield from batches

    kept = []
    assert list(handing_back(run)(iter([1, 2]))) == [1, 2]
    assert resident() < sizes[0] - 100_000_000
