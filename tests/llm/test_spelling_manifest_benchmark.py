"""Spelling variants, the Merkle manifest and benchmark decontamination against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, SF, documents
from tallyhouse.llm import queries
from tallyhouse.llm.decontamination import contamination, decontaminated
from tallyhouse.llm.manifest import climbed, folded, manifest, tampering, verified
from tallyhouse.llm.spelling import near_words, spelling_variants, variants_of_texts, word_counts


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Spelling variants


def counted(rows, every):
    found = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return found


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def grouped(counts, letters, least, times):
    kept = {w: n for w, n in counts.items() if w is not None and n >= least and len(w) >= letters}
    near = {w: [v for v in kept if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in kept}
    best = {w: min(near[w], key=lambda v: (-kept[v], v)) for w in kept if near[w]}
    form = {w: v for w, v in best.items() if kept[v] >= times * kept[w]}
    out = Counter()
    for w, n in kept.items():
        root = w
        while root in form:
            root = form[root]
        out[w, form.get(w), root, n, len(near[w]), kept.get(form.get(w))] += 1
    return out


@pytest.mark.parametrize("every", [0, 3, 31])
def test_word_counts(spark, odd, none, every):
    rows = [*ODD, (20, "Äpfel ÄPFEL x×y÷z naïve Zoë-ZOË", "a"), (21, "a b c " * 50, "a")]
    got = dict(word_counts(documents(spark, rows), every).collect())
    assert got == counted(rows, every)
    assert word_counts(none, every).collect() == []


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_links_do_not_depend_on_the_size_of_groups(spark, group):
    """Few letters, so that signatures are crowded; repeated letters, so that several deletions leave the same."""
    rng = random.Random(group)
    words = sorted({"".join(rng.choice("abcñ") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = Counter(tuple(sorted((r.a_word, r.b_word))) for r in near_words(df, group).collect())
    assert got == Counter((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_spelling_variants(spark):
    rng = random.Random(2)
    counts = Counter()
    for base in ("language", "straßenbahn", "àéîõüñç", "aaaaaaaa", "abababab"):
        counts[base] = 50_000
        for _ in range(40):
            word = list(base)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(word))
                word[at : at + 1] = rng.choice(["", rng.choice("abcé"), word[at] + rng.choice("abcé")])
            counts["".join(word)] = rng.choice([1, 2, 5, 49, 50, 500, 5000])
    counts |= {"tieword1": 9, "tieword2": 90, "tieword3": 90, "chainedq": 2, "chainedqq": 20, "chainedqqq": 200}
    rows = [*counts.items(), (None, 7), ("short", 99)]
    df = spark.createDataFrame(rows, "word string, n long").withColumn("near", F.lit("x"))
    for letters, least, times in ((7, 2, 10), (1, 1, 2)):
        want = grouped(Counter(dict(rows)), letters, least, times)
        assert rows_of(spelling_variants(df, letters, least, times, group=8)) == want
    twice = spark.createDataFrame([("language", 1), ("language", 1), ("langage", 2)], "word string, n long")
    assert rows_of(spelling_variants(twice)) == grouped(Counter(language=2, langage=2), 7, 2, 10)
    assert spelling_variants(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(df, times=1)


def test_variants_of_odd_texts(spark, odd, none):
    for every in (2, 31):
        assert rows_of(variants_of_texts(odd, every, letters=3)) == grouped(counted(ODD, every), 3, 2, 10)
    assert variants_of_texts(none).collect() == []


def test_registered_spelling_query(spark):
    given = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op11_spelling_variants"](spark, SF)) == grouped(counted(given, 31), 7, 2, 10)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fan):
    """(root, siblings of each leaf as (before, after) by level)."""
    paths = [[] for _ in leaves]
    nodes, below = list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fan, len(nodes))) for i in range(0, len(nodes), fan)]
        for run in runs:
            for node in run:
                before = "".join(nodes[i] for i in run if i < node)
                after = "".join(nodes[i] for i in run if i > node)
                for leaf in below[node]:
                    paths[leaf].append((before, after))
        nodes, below = [sha(*[nodes[i] for i in r]) for r in runs], [sum((below[i] for i in r), []) for r in runs]
    return nodes[0], paths


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest_brute(rows, fan):
    """Rows (doc_id, source, lang, n_chars, text)."""
    def leaf(row, add=0):
        i, source, lang, n, text = row
        return sha(*map(part, (i, source, lang, None if n is None else n + add, text)))

    def order(value):
        return (value is not None, value if value is not None else 0)

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in rows if r[2] == v), key=lambda r: (order(r[0]), leaf(r))) for v in langs]
    built = [tree([leaf(r) for r in g], fan) for g in groups]
    root, above = tree([b[0] for b in built], fan)
    out = Counter()
    for group, (subroot, paths), upper in zip(groups, built, above):
        for row, path in zip(group, paths):
            path = path + upper
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, 1 if tampered else 0)
            for before, after in path:
                node = sha(before, node, after)
            out[row[0], leaf(row), subroot, root, sha(*[b + a for b, a in path]), node, node == root] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rn long, tree string, at int, node int, path string"


def manifest_rows(spark, rows, slices=3):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA).repartition(slices)


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_manifest(spark, fan, monkeypatch):
    """Trees over several rounds of small blocks; null, repeated and tied rows; columns that clash."""
    monkeypatch.setattr("tallyhouse.llm.manifest.LEAVES", 4)
    rng = random.Random(fan)
    langs = [None, "", "en", "é", "zz"]
    rows = [(i, "s", rng.choice(langs[2:]), len(str(i)), "t" * rng.randrange(9)) for i in range(60)]
    rows += [(None, None, None, None, None), (None, "a", None, 1, ""), (7, None, "", None, "é"), (7, None, "", None, "é")]
    rows += [(5, "tie", "en", 3, "x"), (5, "tie", "en", 4, "y"), (100, "one", "alone", None, "z" * 5000)]
    got = verified(manifest_rows(spark, rows), fan, **tampering()).select(*COLUMNS)
    assert rows_of(got) == manifest_brute(rows, fan)


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", 3, "t") for i in range(n)]
    got = rows_of(verified(manifest_rows(spark, rows, 1), **tampering()).select(*COLUMNS))
    assert got == (manifest_brute(rows, 2) if rows else Counter())


def test_paths_of_one_long_tree(spark):
    leaves = [sha(str(i)) for i in range(5000)]
    root, paths = tree(leaves, 2)
    nodes = spark.range(5000).select(
        F.lit(3).cast("long").alias("tree"), F.col("id").alias("at"), F.lit(5000).cast("long").alias("n"),
        F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hash"),
    )
    rows, roots = climbed(nodes)
    assert [tuple(r) for r in roots.collect()] == [(3, root)]
    got = {r["at"]: [tuple(s) for s in r["path"]] for r in rows.collect()}
    assert got == dict(enumerate(paths))
    assert rows.where(folded(F.col("hash"), F.col("path")) != root).count() == 0


def test_a_changed_text_breaks_only_its_own_proof(spark):
    rows = [(i, "s", "en", 3, f"t{i}") for i in range(20)]
    change = {"altered": {"text": F.lit("forged")}, "where_altered": F.col("doc_id") == 4}
    got = verified(manifest_rows(spark, rows), **change)
    assert [r.doc_id for r in got.where("not verified").collect()] == [4]
    assert manifest(manifest_rows(spark, rows)).select("root").distinct().count() == 1


# Benchmark decontamination


def normalised(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def hits_brute(docs, items, n):
    windows = {}
    for name, text in items:
        own = normalised(text)
        size = min(n, len(own))
        for at in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[at : at + size]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = Counter()
    for i, text, *_ in docs:
        own, hit, ids = normalised(text), set(), set()
        for size in sizes:
            for at in range(len(own) - size + 1):
                found = windows.get(tuple(own[at : at + size]))
                if found:
                    hit.update(range(at, at + size))
                    ids |= found
        out[i, len(own), len(hit), tuple(sorted(str(x) for x in ids if x is not None))] += 1
    return out


ITEMS = [
    (1, "one two three four five six seven"), (2, "Two THREE"), (3, None), (4, " .,;"), (5, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12"),
    (6, "é"), (10, "one two three four five six seven"), (10, "Two THREE"), (None, "one"), (7, "w"), (8, "x y z"),
]


def item_rows(spark, rows):
    return spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "item_id long, text string, hash int, gram string")


def contaminated(df):
    picked = df.select("doc_id", "n_words", "n_hit", "item_ids", "n_items", "spans").collect()
    for r in picked:
        assert r.n_items == len(r.item_ids)
        assert r.n_hit == sum(s.stop - s.start for s in r.spans)
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in picked)


@pytest.mark.parametrize("n", [1, 3, 10])
@pytest.mark.parametrize("set_bytes", [300, 1 << 20])
def test_contamination(spark, odd, n, set_bytes):
    """With the set in one part and in several; short items; items that share windows; repeated ids and rows."""
    assert contaminated(contamination(odd, item_rows(spark, ITEMS), n, set_bytes=set_bytes)) == hits_brute(ODD, ITEMS, n)


def test_contamination_without_documents_or_items(spark, odd, none):
    assert contamination(none, item_rows(spark, ITEMS)).collect() == []
    for items in ([], [(3, None), (4, "!")]):
        assert contaminated(contamination(odd, item_rows(spark, items))) == hits_brute(ODD, items, 10)


def test_windows_that_overlap_and_repeat(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40))), "s") for i in range(80)]
    items = [(i, "-".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for i in range(12)]
    df = documents(spark, docs)
    assert contaminated(contamination(df, item_rows(spark, items), 5)) == hits_brute(docs, items, 5)


def test_no_broadcast_grows_with_the_set(spark, odd):
    """A set beyond the limit is dealt into parts, each broadcast on its own; documents are counted once."""
    from tallyhouse.llm.decontamination import scanned

    for limit, parts in ((1 << 20, 1), (500, 2)):
        hits, _ = scanned(odd, item_rows(spark, ITEMS), set_bytes=limit)
        text = hits._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("rightHint=(strategy=broadcast)") >= parts and (parts > 1 or "Union" not in text)
        assert hits.where("at is null").count() == len(ODD)


def test_decontaminated(spark):
    docs = [
        (1, "Keep this. One, two: THREE four five! And that.", "s"), (2, "nothing here", "s"), (3, None, "s"), (4, "", "s"),
        (1, "one two three four five", "s"), (1, "one two three four five", "s"), (None, "...one two three four five...", "s"),
    ]
    df = documents(spark, docs)
    items = item_rows(spark, [(1, "one two three four five"), (2, "absent")])
    spans = decontaminated(df, items)
    assert spans.columns == df.columns
    want = [(1, "Keep this! And that."), (2, "nothing here"), (3, None), (4, ""), (1, ""), (1, ""), (None, "...")]
    assert Counter((r.doc_id, r.text) for r in spans.collect()) == Counter(want)
    whole = decontaminated(df, items, "documents")
    assert Counter((r.doc_id, r.text) for r in whole.collect()) == Counter([(2, "nothing here"), (3, None), (4, "")])
    assert decontaminated(df.where("false"), items).collect() == []
