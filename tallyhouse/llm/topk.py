"""Exact top-k inner products by block-at-a-time pruning.

Each component of a vector is a term; its value is an integer that may be negative, so a block of documents keeps the
largest and the smallest value of every term. For a query these give a bound on any score in the block: the sum over terms
of the larger product. Inside a document range the blocks are taken in the order of their bounds and scored through their
forward index (the rows of the block) until the bounds fall below the query's k-th score so far.

Ranges are Spark groups: every chunk of queries meets every document range in a task of its own, and the best ``k`` of each
range are merged per query. Equal vectors are one document during the search; of a group of equal vectors only the ``k + 1``
smallest ids can ever be among the best, as ties go to the smaller id, so no result is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import written

BLOCK = 64  # rows of a block
RANGE = 8192  # distinct vectors of a document range, about
CHUNK = 2048  # distinct queries that meet a range in one task, about


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def dense(rows: pd.Series, dtype: type) -> np.ndarray:
    """Vectors as a matrix; shorter ones are padded with zeros."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows; in doubles where every sum fits into 53 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _order(values: np.ndarray) -> np.ndarray:
    """An order that puts like vectors next to each other: by nearest of some rows, then by the product with it."""
    pivots = values[:: max(1, len(values) // 128)][:128].astype(float)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
    near = values.astype(float) @ pivots.T
    best = near.argmax(axis=1)
    return np.lexsort((-near[np.arange(len(values)), best], best))


def range_top(
    docs: np.ndarray, names: np.ndarray, queries: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: the names and scores of the best ``k`` documents of the range, ties to the smaller name."""
    order = _order(docs)
    docs, names = docs[order], names[order]
    cuts = np.arange(0, len(docs), BLOCK)
    high, low = np.maximum.reduceat(docs, cuts), np.minimum.reduceat(docs, cuts)
    bounds = products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    for q, row in enumerate(queries):
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step, at = 1, 0
        while at < len(cuts):
            take = visit[q, at : at + step]
            if len(found) >= k:
                take = take[bounds[q, take] >= scores.min()]
                if not len(take):
                    break
            rows = np.concatenate([np.arange(c, min(c + BLOCK, len(docs))) for c in cuts[take]])
            scores = np.concatenate([scores, products(row[None], docs[rows])[0]])
            found = np.concatenate([found, names[rows]])
            if len(scores) > k:
                good = np.lexsort((found, -scores))[:k]
                scores, found = scores[good], found[good]
            at, step = at + step, step * 2
        yield q, found, scores


def exact_top_k(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every query row of ``vectors`` (vec_id, embedding).

    Components are turned into ``floor(256 * x)``; the score is their integer inner product, which has to fit into a long.
    Ties go to the smaller vec_id. Queries with fewer than ``k`` candidates get all. Vectors that are null or hold null or
    non-finite components take no part, nor do rows with a null vec_id; shorter vectors count as padded with zeros, an empty
    vector as zeros only. Rows that repeat both vec_id and vector count once, and a row never finds its own id. An empty
    table gives no rows; other columns are ignored.
    """
    terms = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), queries.alias("asks"), terms.alias("terms")
    )
    good = good.withColumns({"h1": F.xxhash64("terms"), "h2": F.hash("terms")})
    groups = good.groupBy("h1", "h2").agg(
        F.first("terms").alias("terms"), F.max("asks").alias("asks"), F.min("vec_id").alias("name")
    )
    groups = written(groups)
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = good.select("h1", "h2", "vec_id").distinct().withColumn("nth", first).where(F.col("nth") <= k + 1)
    members = written(members.join(groups.select("h1", "h2", "name"), ["h1", "h2"]).select("name", "vec_id"))
    asking = written(
        good.where("asks").select("h1", "h2", F.col("vec_id").alias("query_id")).distinct()
        .join(groups.select("h1", "h2", F.col("name").alias("asked")), ["h1", "h2"]).select("asked", "query_id")
    )
    sizes = groups.agg(F.count(F.lit(1)), F.sum(F.col("asks").cast("long"))).first()
    n_ranges, n_chunks = -(-(sizes[0] or 0) // RANGE) or 1, -(-(sizes[1] or 0) // CHUNK) or 1

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    docs = groups.select(
        "name", "terms", F.pmod("h1", F.lit(n_ranges)).cast("int").alias("range"), spread(n_chunks).alias("chunk")
    )
    asks = groups.where("asks").select(
        "name", "terms", F.pmod("h1", F.lit(n_chunks)).cast("int").alias("chunk"), spread(n_ranges).alias("range")
    )

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(queries):
            both = dense(pd.concat([own["terms"], queries["terms"]]), np.int64)
            named = queries["name"].to_numpy()
            for q, found, scores in range_top(both[: len(own)], own["name"].to_numpy(), both[len(own) :], k + 1):
                out.append(pd.DataFrame({"asked": named[q], "name": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"asked": [], "name": [], "score": []}).astype("int64")

    found = docs.groupBy("chunk", "range").cogroup(asks.groupBy("chunk", "range")).applyInPandas(
        search, "asked long, name long, score long"
    )
    return best_rows(found, members, asking, k)


def best_rows(found: DataFrame, members: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """From groups of equal vectors back to rows: (query_id, rank, vec_id, score).

    ``found`` (asked, name, score) holds, for every asked group, its best groups; ``members`` (name, vec_id) the ``k + 1``
    smallest ids of each group and ``asking`` (asked, query_id) the query rows of each asked group.
    """
    best = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    rows = found.join(members, "name").withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k + 1)
    rows = written(rows.select("asked", "vec_id", "score"))
    own = asking.join(rows, "asked").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
