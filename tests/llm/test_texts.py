"""Near duplicates, repeats, mixing, packing and language-model scores against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.conftest import ODD, SF, documents
from tallyhouse.llm import backoff_lm, packing, queries, suffix_dedup
from tallyhouse.llm.backoff_lm import scored
from tallyhouse.llm.induced_sort import repeated_starts, suffix_order
from tallyhouse.llm.mixing import mix, mixed_documents, taken_words
from tallyhouse.llm.near_dedup import near_duplicates
from tallyhouse.llm.suffix_dedup import removed_repeats, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]


def given(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def near_brute(rows, n, percent):
    sets, parent = [], {}
    for i, text, _ in rows:
        own = lowered(text)
        sets.append(set(zip(*[own[k:] for k in range(n)])) if len(own) >= n else {tuple(own)} if own else set())
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j, common = rows[a][0], rows[b][0], len(sets[a] & sets[b])
            if None not in (i, j) and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), top(i), i == top(i)) for (i, _, _), s in zip(rows, sets))


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, none, n, percent):
    for rows, df in ((ODD, odd), (given(spark), documents(spark, given(spark)))):
        assert Counter(map(tuple, near_duplicates(df, n, percent).collect())) == near_brute(rows, n, percent)
    assert near_duplicates(none, n, percent).collect() == []


def test_near_duplicates_in_a_large_group(spark):
    """Copies at all distances from one text: many are linked only through others."""
    rng = random.Random(3)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(14)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(own), "a"))
    got = near_duplicates(documents(spark, rows).repartition(4), 3, 85).collect()
    assert Counter(map(tuple, got)) == near_brute(rows, 3, 85)


def repeats_brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()] += 1
    return out


def test_removed_repeats(spark, odd, none):
    rng = random.Random(5)
    small = [(i, "".join(rng.choice("abñ") for _ in range(rng.randrange(60))), "a") for i in range(60)]
    small += [(i + 60, t, "a") for i, (_, t, _) in enumerate(small[:5])] + [(99, "ab" * 50, "a"), (100, "x" * 70, "a")]
    for length in (5, 12, 40):
        assert Counter(map(tuple, removed_repeats(documents(spark, small), length).collect())) == repeats_brute(small, length)
    few = [r for r in ODD if len(r[1] or "") < 5000]
    assert Counter(map(tuple, removed_repeats(documents(spark, few)).collect())) == repeats_brute(few, 400)
    rows = given(spark)
    assert Counter(map(tuple, removed_repeats(documents(spark, rows)).collect())) == repeats_brute(rows, 400)
    assert len(removed_repeats(odd).collect()) == len(ODD)
    assert removed_repeats(none).collect() == []


def least_line(rng, letters, size):
    """A line of ``size`` bytes that holds the least hash of windows around it, whatever stands there."""
    while True:
        line = "".join(rng.choice(letters) for _ in range(size))
        around = ["".join(rng.choice(letters) for _ in range(350)) + line + "".join(rng.choice(letters) for _ in range(350)) for _ in range(4)]
        if set.intersection(*[set(suffix_dedup.window_runs(np.frombuffer(t.encode(), np.uint8), 400)[0].tolist()) for t in around]):
            return line


@pytest.mark.parametrize("size", [40, 380])
def test_a_common_line_is_split_further(spark, monkeypatch, size):
    """No hash brings more than a shard of pieces to one task, though one line stands in very many different texts."""
    rng, letters = random.Random(size), "abcdefghijklmnopqrstuvwxyz "
    line = least_line(rng, letters, size)

    def some(n):
        return "".join(rng.choice(letters) for _ in range(n))

    rows = [(i, some(380) + line + some(380), "a") for i in range(3000)]
    for i in range(20):  # real repeats around the line, at other places and with other neighbours
        rows.append((5000 + i, some(30 + i) + rows[i][1][150 : 150 + 560 + i] + some(i), "a"))
    seen, sort = [], suffix_dedup._sorted_shards

    def watched(pieces, length, n_shards):
        seen.append(pieces.groupBy("h").agg(F.sum(F.octet_length("bytes")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return sort(pieces, length, n_shards)

    monkeypatch.setattr(suffix_dedup, "SHARD", 50_000)
    monkeypatch.setattr(suffix_dedup, "_sorted_shards", watched)
    got = Counter(map(tuple, removed_repeats(documents(spark, rows)).collect()))
    assert len(seen) > 1 and max(seen) <= 50_000
    assert got == repeats_brute(rows, 400)


@pytest.mark.parametrize("shard", [300])
def test_removed_repeats_where_all_is_split(spark, odd, none, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    test_removed_repeats(spark, odd, none)


def test_texts_without_repeats(spark):
    rows = [(1, "abcdefgh-1", "a"), (2, "2-abcdefgh", "a"), (3, None, "a"), (4, "plain", "a")]
    got = without_repeats(documents(spark, rows), 8)
    assert got.columns == documents(spark, rows).columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: ("-1", 2), 2: ("2-", 2), 3: (None, 0), 4: ("plain", 5)}


def test_suffix_order():
    rng = random.Random(7)
    with tempfile.TemporaryDirectory() as name:
        for _ in range(150):
            k = rng.choice([1, 2, 3, 20])
            own = [rng.randint(1, k) for _ in range(rng.randint(1, 60))] + [0]
            want = sorted(range(len(own)), key=lambda i: own[i:])
            assert suffix_order(np.array(own, np.int32), k + 1, Path(name)).tolist() == want


def test_suffix_order_recurses(monkeypatch):
    monkeypatch.setattr("tallyhouse.llm.induced_sort.FEW", 4)
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(200))) for _ in range(20)] * 2
    seen = Counter(t[p : p + 9] for t in texts for p in range(len(t) - 8))
    want, at = [], 0
    for t in texts:
        want += [at + p for p in range(len(t) - 8) if seen[t[p : p + 9]] > 1]
        at += len(t) + 1
    assert repeated_starts(texts, 9).tolist() == want


def targets_brute(rows):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped, left, total = {}, set(order), 1.5 * sum(size.values())
    while True:
        rest, all_ = total - sum(capped.values()), sum(weight[s] for s in left)
        share = {s: rest * weight[s] / all_ for s in left}
        over = [s for s in left if share[s] > 2 * size[s]]
        if not over:
            return size, capped | share
        for s in over:
            capped[s] = 2 * size[s]
            left.discard(s)


def test_mixing(spark, odd, none):
    for rows, df in ((ODD, odd), (given(spark), documents(spark, given(spark)))):
        size, target = targets_brute(rows)
        got = taken_words(df).collect()
        assert Counter(got) == Counter(taken_words(df).collect())
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
        source, taken = {i: s for i, _, s in rows}, Counter()
        for r in got:
            assert r.taken <= 2 * r["size"]
            if r.doc_id is not None:
                assert r.source_size == size[source[r.doc_id]]
                assert math.isclose(r.target, target[source[r.doc_id]], abs_tol=1e-6)
            taken[round(r.target, 6), r.source_size] += r.taken
        for (t, s), n in taken.items():
            assert abs(n - t) <= 130 or abs(n / t - 1) < 0.05 or list(target.values()).count(t) > 1
    assert taken_words(none).collect() == []


def test_mixing_blocks(spark):
    """Slots use every block of a source equally often up to one, and the shards hold all slots."""
    mixed = mix(documents(spark, given(spark)), block=16)
    slots = [tuple(r) for r in mixed.slots.select("s", "epoch", "block").collect()]
    assert len(set(slots)) == len(slots)
    for r in mixed.sources.collect():
        own = [x for x in slots if x[0] == r.s]
        assert len(own) == r.n_slots and all(0 <= b < r.n_blocks for _, _, b in own)
        full = Counter(e for _, e, _ in own)
        assert all(full[e] == r.n_blocks for e in full if e < max(full))


def test_mixed_documents(spark, odd, none):
    for df in (odd, documents(spark, given(spark))):
        taken = Counter()
        for r in taken_words(df).collect():
            taken[r.doc_id] += r.taken
        got = mixed_documents(df)
        assert got.columns == df.columns
        found, texts = Counter(), {r.doc_id: r.text for r in df.collect()}
        for r in got.collect():
            found[r.doc_id] += len(words(r.text))
            assert r.n_chars == len(r.text)
            if r.doc_id in (9, 10) and len(words(r.text)) == len(words(texts[r.doc_id])):
                assert r.text == texts[r.doc_id]
        assert +found == +taken
    assert mixed_documents(none).collect() == []


def test_packing(spark, odd, none):
    reference = Tokenizer.from_file(TOKENS)
    for rows, df in ((ODD, odd), (given(spark), documents(spark, given(spark)))):
        got = packing.packed_documents(df, TOKENS).collect()
        want = Counter()
        for i, text, _ in rows:
            ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
            starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
    assert packing.packed_documents(none, TOKENS).collect() == []


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    return Counter(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(100):
        capacity = rng.choice([10, 37, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(200))]
        used = Counter()
        for length, a, b, first, per, at in packing.best_fit_plan(Counter(lengths), capacity):
            for rank in range(a, b):
                used[first + (rank - a) // per] += length
        assert Counter(capacity - n for n in used.values()) == best_fit(lengths, capacity)


def test_packed_sequences_hold_the_ids(spark):
    df = documents(spark, [(1, "a b c", "x"), (2, "d " * 30, "x"), (3, "e", "x")])
    pieces = packing.token_pieces(df, TOKENS, capacity=16, with_ids=True)
    packed = packing.pack(pieces, ["doc_id", "piece"], capacity=16)
    rows = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def backoff_brute(rows, order, alpha):
    counts, own = Counter(), []
    for _, text, _ in rows:
        w = lowered(text)
        mine = Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        own.append((w, mine))
        counts += mine
    total = sum(len(w) for w, _ in own)
    out = []
    for (i, _, _), (w, mine) in zip(rows, own):
        score, missed = 0.0, 0
        for k in range(len(w)):
            steps = 0
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                left = counts[gram] - mine[gram]
                under = counts[gram[:-1]] - mine[gram[:-1]] if n > 1 else total - len(w)
                if left > 0 and under > 0:
                    score += math.log(left / under) + steps * math.log(alpha)
                    missed += steps > 0
                    break
                steps += 1
            else:
                score += steps * math.log(alpha) - math.log(max(1, total))
                missed += 1
        out.append((i, len(w), missed, round(score, 5)))
    return Counter(out)


@pytest.mark.parametrize("order", [2, 3])
def test_backoff_scores(spark, odd, none, order):
    for rows, df in ((ODD, odd.repartition(3, F.xxhash64("doc_id", "text"))), (given(spark), documents(spark, given(spark)))):
        got = Counter((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 5)) for r in scored(df, order).collect())
        assert got == backoff_brute(rows, order, 0.4)
    assert scored(none, order).collect() == []


def test_registered_scores_count_three_words(spark):
    got = queries.lm_scores(spark, SF).collect()
    got = Counter((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 5)) for r in got)
    assert got == backoff_brute(given(spark), 3, 0.4)
    # Every pair of the last text is common, none of its phrases is.
    rows = [(i, t, "a") for i, t in enumerate(["a b c", "a b c", "b c a", "b c a", "c a b", "c a b"] * 3 + ["x b d b x", "d b x b d", "x b x"])]
    rows = [*rows, (99, "a b x", "a")]
    assert {r.doc_id: r.n_backed_off for r in scored(documents(spark, rows)).collect()}[99] == 1


def test_blocks_go_on_over_batches(monkeypatch):
    batches = [pa.record_batch({"text": pa.array(["ab" * 5, None]), "doc_id": pa.array([i, None])}) for i in range(7)]
    monkeypatch.setattr(backoff_lm, "BLOCK", 30)
    blocks = [(t.to_pylist(), i) for t, i in backoff_lm._blocks(iter(batches))]
    assert [len(i) for _, i in blocks] == [6, 6, 2]
    assert sum((t for t, _ in blocks), []) == ["ab" * 5, None] * 7 and sum((i for _, i in blocks), [])[::2] == list(range(7))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_packed_ngrams_take_the_bytes_of_their_differences(n):
    """A part of the hash range far from zero; a step over most of the range and steps of one are kept too."""
    far = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n).astype(np.uint64) + np.uint64(200 << 48))
    assert (backoff_lm._unpack(backoff_lm._pack(far)) == far).all()
    assert len(backoff_lm._pack(far)) <= 40 + 6 * n
    for values in ([5, 5 + (1 << 60)], [1 << 55, (1 << 55) + 1, (1 << 55) + 2]):
        assert backoff_lm._unpack(backoff_lm._pack(np.array(values, np.uint64))).tolist() == values
    texts = pa.array(["a", None, "é", "", "é b"])[: n + 1]
    assert backoff_lm._unsqueeze_texts(backoff_lm._squeeze_texts(texts)).to_pylist() == texts.to_pylist()
