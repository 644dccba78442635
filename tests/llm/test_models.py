"""Vector searches against brute force; url rules, toxicity and quality on made labels, held-out rows and odd tables."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, SF, documents
from tallyhouse.llm import kmeans_tree
from tallyhouse.llm.kmeans_tree import nearest
from tallyhouse.llm.site_quality import host_and_path, judged
from tallyhouse.llm.topk import exact_top_k
from tallyhouse.llm.toxicity import fit_severity, graded
from tallyhouse.llm.url_rules import judged_urls, mined_rules, tokens

VECTORS = "vec_id long, embedding array<double>, label int, score string, name int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS)


def odd_vectors():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(150)]
    rows += [(i, [0.5, -0.25, 0.0, 1.0]) for i in range(150, 190)]  # one group of equal vectors
    rows += [(190, None), (191, [0.0] * 4), (192, [1.0, None, 0.0, 0.0]), (193, [NAN, 1.0, 1.0, 1.0]), (194, [INF, 1.0, 1.0, 1.0])]
    rows += [(200, [0.1, 0.2]), (None, [1.0, 1.0, 1.0, 1.0]), (3, rows[3][1])]
    return rows


def searched(rows, asked, k, score, zero):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            good[i] = np.pad(np.array(v, float), (0, 4 - len(v)))
    out = Counter()
    for q in [i for i in good if asked(i)]:
        best = sorted((-score(good[q], good[i]), i) for i in good if i != q)[:k]
        for rank, (s, i) in enumerate(best, 1):
            out[q, rank, i, round(-s, 9)] += 1
    return out


def test_exact_top_k(spark):
    def score(a, b):
        return int(np.floor(256 * a) @ np.floor(256 * b))

    df = vectors(spark, odd_vectors())
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == searched(odd_vectors(), lambda i: i % 10 == 0, 5, score, True)
    few = [(0, [1.0]), (50, [2.0])]
    assert sorted(map(tuple, exact_top_k(vectors(spark, few), F.col("vec_id") % 50 == 0, 5).collect())) == [
        (0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert exact_top_k(vectors(spark, []), F.lit(True), 5).collect() == []


def test_nearest_finds_all_on_a_small_table(spark):
    df = vectors(spark, odd_vectors())
    got = Counter(
        (r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(df, F.col("vec_id") % 10 == 0, 20, 1.0).collect()
    )
    want = searched(odd_vectors(), lambda i: i % 10 == 0, 20, lambda a, b: float(a @ b), False)
    assert got == want
    assert nearest(vectors(spark, []), F.lit(True), 20).collect() == []


def test_nearest_keeps_the_smaller_ids_of_ties(spark):
    """Different vectors that score alike: more than fit, all in one leaf, and quantised ones in many."""
    rng = np.random.default_rng(4)
    alike = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [1.0, 0.001 * (i * 37 % 101), 0.0, 0.0]) for i in range(1, 101)]
    got = nearest(vectors(spark, alike), F.col("vec_id") == 0, 20, 1.0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(i, i, 1.0) for i in range(1, 21)]
    coarse = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]
    got = Counter(
        (r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(vectors(spark, coarse), F.col("vec_id") % 20 == 0, 20, 1.0).collect()
    )
    assert got == searched(coarse, lambda i: i % 20 == 0, 20, lambda a, b: float(a @ b), False)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_nearest_recall(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(rows))
    matrix, hits, total = np.stack([rows[i] for i in ids]), 0, 0
    found = defaultdict(set)
    for r in nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        found[r.query_id].add(r.vec_id)
        assert abs(r.score - float(rows[r.query_id] @ rows[r.vec_id])) < 1e-12
    for q in ids[ids % 20 == 0]:
        near = [i for i in ids[np.argsort(-(matrix @ rows[q]), kind="stable")] if i != q][:20]
        hits += len(found[q] & set(near))
        total += len(near)
    assert hits >= 0.9 * total


def test_nearest_visits_few_leaves(spark, monkeypatch):
    """Vectors without any structure: rows lie in several leaves, so that a query needs a small share of the leaves."""
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(8200, 32))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    seen, calibrated = [], kmeans_tree._calibrated

    def watched(indexed, tree, *rest):
        seen.append((calibrated(indexed, tree, *rest), sum(not n for _, n in tree.children)))
        return seen[-1][0]

    monkeypatch.setattr(kmeans_tree, "_calibrated", watched)
    found = defaultdict(list)
    for r in nearest(vectors(spark, list(enumerate(matrix.tolist()))), F.col("vec_id") % 20 == 0, 20).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    hits = 0
    for q in range(0, 8200, 20):
        products = matrix @ matrix[q]
        products[q] = -np.inf
        assert sorted(rank for rank, _ in found[q]) == list(range(1, 21)) and len({i for _, i in found[q]}) == 20
        hits += len({i for _, i in found[q]} & set(np.argsort(-products)[:20].tolist()))
    assert hits >= 0.95 * 410 * 20
    [(visits, leaves)] = seen
    assert visits <= 0.25 * leaves


def test_url_rules(spark):
    urls = {
        1: ("https://EXAMPLE.com/en/a?x=1", "example.com", "/en/a", "example.com/en/", "block"),
        2: ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("http://m.www.example.com/en/x#y", "m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        4: ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        5: ("ftp://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        6: ("http://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
        7: ("http://a.net", "a.net", "", None, "allow"),
        8: ("http://x.com", "x.com", "", None, "allow"),
        9: ("nothing", "", "", None, "allow"),
        10: (None, "", "", None, "allow"),
        11: ("http://É.ORG?q://z/", "É.org", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], "<p>", 1, "t") for i, u in urls.items()] + [(None, urls[1][0], "", 1, "t")],
                                  "page_id long, url string, html string, rule int, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = judged_urls(pages, labels).collect()
    assert {r.page_id: tuple(r)[1:5] for r in got if r.page_id} == {i: u[1:] for i, u in urls.items()}
    assert len(got) == 12
    assert judged_urls(pages.limit(0), labels).collect() == []


def test_mined_url_rules(spark):
    rows = [(i, f"http://{'casino' if i % 3 == 0 else 'fine'}.org/{'win' if i % 2 else 'read'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(
        [(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i in range(200)] + [(None, 0, 1), (5, None, None)],
        "doc_id long, quality int, toxic int",
    )
    verdict = {r.page_id: r.verdict for r in judged_urls(pages, labels).collect()}
    assert all(verdict[i] == ("block" if i % 3 == 0 and i % 2 else "allow") for i in range(300))


def test_segments_with_digits_are_told_apart(spark):
    """Bad urls that only a segment with digits in it tells from good ones; page numbers name one page and are no tokens."""
    rows = [(i, f"http://fine.org/{'casino888' if i % 3 == 0 else 'mp3'}/{i}/{i}.html") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    verdict = {r.page_id: r.verdict for r in judged_urls(pages, labels).collect()}
    assert all(verdict[i] == ("allow" if i % 3 else "block") for i in range(90))
    url = F.lit("http://a.b/top10-pills/12/12.html")
    assert spark.range(1).select(tokens(url, F.lit("a.b"), F.lit("/top10-pills/12/12.html"))).first()[0] == ["h:a.b", "h:b", "p:top10-pills"]


def test_mined_rules_against_counted_ones(spark):
    """Every combination of tokens is counted; those with the support and the confidence are the rules."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        own = [t for t, p in zip("abcde", (0.9, 0.5, 0.3, 0.2, 0.1)) if rng.random() < p]
        rows.append((own, bool(rng.random() < (0.9 if {"b", "c"} <= set(own) else 0.15))))
    want = {}
    for size in range(1, 6):
        for kept in combinations("abcde", size):
            held = [bad for own, bad in rows if set(kept) <= set(own)]
            if sum(held) >= 0.02 * len(rows) and sum(held) >= 0.5 * len(held):
                want[kept] = sum(held) / len(held)
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {tuple(r.tokens): r.confidence for r in mined_rules(df, 0.02, 0.5).collect()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_redirect_is_booked_on_the_host_it_stands_on(spark):
    url = F.lit("http://A.com/out?u=http://b.com/x")
    assert tuple(spark.range(1).select(*host_and_path(url)).first()) == ("a.com", "out")


@pytest.fixture(scope="module")
def halves(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    return spark.read.parquet(f"{folder}/documents.parquet"), labels.where(~held), labels.where(held), spark.read.parquet(f"{folder}/pages.parquet")


def test_toxicity_on_held_out_rows(halves):
    docs, learned, held, _ = halves
    rows = graded(docs, fit_severity(docs, learned)).join(held.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    assert rows
    wrong = [r for r in rows if r.toxic != bool(r.truth)]
    assert len(wrong) <= 0.05 * len(rows)
    assert sum(r.toxic for r in wrong) <= 0.01 * len(rows)
    assert all(0 <= r.severity <= 2 for r in rows)


def test_toxicity_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(7, 1, 0), (9, 0, 1), (None, 1, 1), (4, 1, None), (5, 1, 3)], "doc_id long, quality int, toxic int")
    out = graded(odd, fit_severity(odd, labels))
    assert out.count() == len(ODD) and set(out.columns) == set(odd.columns) | {"severity", "grade"}
    assert not any(r.toxic for r in graded(odd, fit_severity(odd, labels.limit(0))).collect())
    assert graded(none, fit_severity(none, labels)).collect() == []


def test_quality_on_held_out_rows(halves):
    docs, learned, held, pages = halves
    rows = judged(docs, learned, pages).join(held.withColumnRenamed("quality", "truth"), "doc_id").collect()
    assert sum(r.kept == bool(r.truth) for r in rows) >= 0.95 * len(rows)


def test_quality_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(7, 1, 0), (9, 0, 1), (9, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(7, "http://a.b/c/d", ""), (7, None, ""), (8, "none", ""), (None, "x://y", "")], "page_id long, url string, html string")
    out = judged(odd, labels, pages).collect()
    assert len(out) == len(ODD) and all(0 <= r.quality <= 1 for r in out)
    assert {r.host for r in out if r.doc_id == 7} == {"a.b"}
    assert len(judged(odd, labels.limit(0), pages.limit(0)).collect()) == len(ODD)
    assert judged(none, labels, pages).collect() == []


def test_a_sparse_site_is_shrunk_more(spark):
    rows = [(i, f"plain words number {i} go here", f"s{0 if i < 90 else i}") for i in range(100)]
    labels = spark.createDataFrame([(i, int(i % 9 != 0 and i < 95), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    out = {r.doc_id: r for r in judged(documents(spark, rows), labels, pages).collect()}
    assert len(out) == 100 and out[98].host == "s98"


def test_queries_are_all_there(spark):
    from tallyhouse.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    for name, query in QUERIES.items():
        assert query(spark, SF).count() > 0, name
