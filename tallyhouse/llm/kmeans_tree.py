"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fit on a bounded sample (``SAMPLE`` distinct vectors, all of them if there are fewer); every row is indexed: it
is put into the leaves of the ``SPILL`` nearest centres. A query takes nodes from a priority queue, best product with the
centre first, until it has visited ``visits`` leaves and met enough rows. ``visits`` is calibrated: exact neighbours of
``PROBES`` queries over all rows tell how far the visits have to widen until the wanted recall is reached. As a neighbour
is met in any of its leaves, a query needs far fewer of them than if rows lay in one leaf each, and meets fewer rows.

Leaves are joined with the queries that visit them; a large leaf and a leaf with many queries are dealt out in parts. What
a query finds in several leaves counts once.
Equal vectors are one candidate during the search, and only the smallest ids of such a group can be among the nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import written
from tallyhouse.llm.topk import best_rows, dense, usable

SAMPLE = 20_000  # vectors that the tree is fit on at most
BRANCHES = 16
LEAF = 128  # distinct vectors of a leaf, about
SPILL = 8  # leaves that a vector is put into; fewer if the table has less than LEAF * SPILL distinct vectors for each
SPREAD = 16  # leaves that the tree has at least for each of them
LEAF_SAMPLE = 8  # sampled vectors that a leaf needs at least
PROBES = 256  # queries with exact neighbours at most
RECALL = 0.97
PART = 4096  # rows or queries of a leaf that meet in one task, about


@dataclass
class Tree:
    """Nodes by number, 0 the root: centres, and for inner nodes the first child and how many; leaves have none.

    The centre of an inner node is the mean of the leaf centres below it; ``reach`` is by how much the best of these is
    likely to exceed it in the direction of a query of length one.
    """

    centres: np.ndarray
    children: list[tuple[int, int]]
    leaves: np.ndarray = field(init=False)
    reach: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n_nodes, width = self.centres.shape
        inner = np.array([n > 0 for _, n in self.children])
        self.leaves = np.flatnonzero(~inner)
        n, total, squares = (~inner).astype(float), self.centres.copy(), (self.centres**2).sum(axis=1)
        for at in range(n_nodes - 1, -1, -1):  # children have larger numbers than their parent
            if inner[at]:
                own = slice(self.children[at][0], sum(self.children[at]))
                n[at], total[at], squares[at] = n[own].sum(), total[own].sum(axis=0), squares[own].sum()
        self.centres = total / n[:, None]
        spread = np.maximum(squares / n - (self.centres**2).sum(axis=1), 0) / max(1, width)
        self.reach = np.where(inner, np.sqrt(2 * np.log(n) * spread), 0.0)

    def leaves_of(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """For each vector the ``n`` leaves (all, if fewer) of the nearest centres, nearest first."""
        far = _distances(vectors, self.centres[self.leaves])
        n = min(n, len(self.leaves))
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        order = np.lexsort((near, np.take_along_axis(far, near, axis=1)), axis=1)
        return self.leaves[np.take_along_axis(near, order, axis=1)]

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order; an inner node comes by the best product that a centre below it is likely to have."""
        near = -(self.centres @ query + self.reach * np.sqrt(query @ query))
        near = near.tolist()
        queue = [(near[0], 0)]
        while queue:
            _, at = heapq.heappop(queue)
            first, n = self.children[at]
            if not n:
                yield at
                continue
            for child in range(first, first + n):
                heapq.heappush(queue, (near[child], child))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b * b).sum(axis=1) - 2 * (a @ b.T)


def _k_means(vectors: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(turns):
        own = _distances(vectors, centres).argmin(axis=1)
        kept = np.unique(own)
        centres = np.stack([vectors[own == j].mean(axis=0) for j in kept])
    return centres, _distances(vectors, centres).argmin(axis=1)


def _stretched(centres: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Centres as long as their vectors are on average: a mean is shorter, the more so the fewer vectors point its way."""
    lengths, out = np.linalg.norm(vectors, axis=1), centres.copy()
    for j in np.unique(own):
        if length := np.linalg.norm(centres[j]):
            out[j] *= lengths[own == j].mean() / length
    return out


def fit_tree(sample: np.ndarray, leaf: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """Splits by k-means until a node holds at most ``leaf`` of the sampled vectors or does not split."""
    rng = np.random.default_rng(seed)
    centres, children, waiting = [sample.mean(axis=0)], [(0, 0)], [(0, sample)]
    while waiting:
        node, own = waiting.pop()
        if len(own) <= leaf:
            continue
        found, of = _k_means(own, min(branches, -(-len(own) // leaf)), rng)
        found = _stretched(found, own, of)
        of = _distances(own, found).argmin(axis=1)
        used = np.unique(of)
        if len(used) < 2:
            continue
        children[node] = (len(centres), len(used))
        for j in used:
            waiting.append((len(centres), own[of == j]))
            centres.append(found[j])
            children.append((0, 0))
    return Tree(np.stack(centres), children)


def _scores(queries: np.ndarray, docs: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the names and products of its best ``k`` rows, ties to the smaller name.

    Each product is summed on its own, in one order. All rows whose rough product is within rounding of the k-th are summed
    so, however many tie there.
    """
    rough = queries @ docs.T
    largest = np.abs(docs).max(axis=0, initial=0)
    slack = 4 * np.finfo(float).eps * docs.shape[1] * (np.abs(queries) @ largest)
    for q, row in enumerate(rough):
        least = np.partition(row, len(row) - k)[len(row) - k] if k < len(row) else -np.inf
        near = np.flatnonzero(row >= least - slack[q])
        exact = (docs[near] * queries[q]).sum(axis=1)
        best = np.lexsort((names[near], -exact))[:k]
        yield names[near][best], exact[best]


def nearest(vectors: DataFrame, queries: Column, k: int, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row of ``vectors`` (vec_id, embedding) its ``k`` nearest found rows.

    Nearness is the inner product in doubles; ties go to the smaller vec_id; queries with fewer than ``k`` candidates get
    all. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null vec_id;
    shorter vectors count as padded with zeros. Rows that repeat both vec_id and vector count once, and a row never finds its
    own id. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).where(
        F.exists("embedding", lambda x: x != 0)
    )
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), queries.alias("asks"), whole.alias("v"))
    good = good.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    groups = written(
        good.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max("asks").alias("asks"), F.min("vec_id").alias("name"))
    )
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = good.select("h1", "h2", "vec_id").distinct().withColumn("nth", first).where(F.col("nth") <= k + 1)
    members = written(members.join(groups.select("h1", "h2", "name"), ["h1", "h2"]).select("name", "vec_id"))
    asking = written(
        good.where("asks").select("h1", "h2", F.col("vec_id").alias("query_id")).distinct()
        .join(groups.select("h1", "h2", F.col("name").alias("asked")), ["h1", "h2"]).select("asked", "query_id")
    )

    n_groups = groups.count()
    sample = groups.orderBy("h1", "h2").select("v").limit(SAMPLE).toPandas()["v"]  # bounded by SAMPLE
    if not len(sample):
        return best_rows(spark.createDataFrame([], "asked long, name long, score double"), members, asking, k)
    share = len(sample) / n_groups
    width = groups.agg(F.max(F.size("v"))).first()[0]
    spill = max(1, min(SPILL, n_groups // (LEAF * SPILL)))
    tree = fit_tree(_wide(dense(sample, float), width), max(LEAF_SAMPLE, round(LEAF / spill * share)))
    spill = max(1, min(spill, len(tree.leaves) // SPREAD))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            if len(own):
                yield own.assign(leaves=list(tree.leaves_of(_wide(dense(own["v"], float), width), spill)))

    indexed = written(
        groups.mapInPandas(placed, "h1 long, h2 int, v array<double>, asks boolean, name long, leaves array<long>")
    )
    sizes = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    in_leaf = {r["leaf"]: r["n"] for r in sizes.collect()}  # leaves are bounded by SAMPLE
    visits = _calibrated(indexed, tree, width, k, recall)

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            asked, leaves = [], []
            for name, query in zip(own["name"], _wide(dense(own["v"], float), width), strict=True):
                seen = met = 0
                for leaf in tree.best_bins(query):
                    if seen >= visits and met > k * spill:  # a row is in that many leaves at most
                        break
                    seen, met = seen + 1, met + in_leaf.get(leaf, 0)
                    asked.append(name)
                    leaves.append(leaf)
            yield pd.DataFrame({"name": asked, "leaf": leaves}).astype("int64")

    asked = indexed.where("asks")
    visit = written(asked.select("name", "v").mapInPandas(visited, "name long, leaf long"))
    parts = sizes.join(visit.groupBy("leaf").agg(F.count(F.lit(1)).alias("asked")), "leaf").select(
        "leaf", F.ceil(F.col("n") / PART).alias("doc_parts"), F.ceil(F.col("asked") / PART).alias("query_parts")
    )

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    docs = indexed.select("h1", "v", "name", F.explode("leaves").alias("leaf")).join(parts, "leaf").select(
        "leaf", "name", "v", F.pmod("h1", "doc_parts").alias("doc_part"), every("query_parts").alias("query_part")
    )
    asks = visit.join(asked.select("name", F.col("v").alias("asked_v"), "h1"), "name").join(parts, "leaf").select(
        "leaf", F.col("name").alias("asked"), "asked_v", F.pmod("h1", "query_parts").alias("query_part"),
        every("doc_parts").alias("doc_part"),
    )

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        asked, names, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(own) and len(asking):
            found = _scores(
                _wide(dense(asking["asked_v"], float), width), _wide(dense(own["v"], float), width), own["name"].to_numpy(), k + 1
            )
            for name, (near, products) in zip(asking["asked"], found, strict=True):
                asked.append(np.full(len(near), name))
                names.append(near)
                scores.append(products)
        return pd.DataFrame(
            {"asked": np.concatenate(asked), "name": np.concatenate(names), "score": np.concatenate(scores)}
        )

    keys = ["leaf", "doc_part", "query_part"]
    found = docs.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(search, "asked long, name long, score double")
    best = F.dense_rank().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "name"))  # the same in any leaf
    found = found.withColumn("nth", best).where(F.col("nth") <= k + 1).select("asked", "name", "score").distinct()
    return best_rows(found, members, asking, k)


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, max(0, width - matrix.shape[1]))))


def _calibrated(indexed: DataFrame, tree: Tree, width: int, k: int, recall: float) -> int:
    """Leaves to visit so that the probes find the wanted share of their exact neighbours over all rows."""
    probes = indexed.where("asks").orderBy("h1", "h2").select("name", "v").limit(PROBES).toPandas()
    if not len(probes):
        return 1
    queries, asked = _wide(dense(probes["v"], float), width), probes["name"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[np.ndarray]] = {}  # names, products and leaves of a probe's best rows
        for own in batches:
            if not len(own):
                continue
            docs, names, leaves = _wide(dense(own["v"], float), width), own["name"].to_numpy(), np.stack(own["leaves"])
            order = np.argsort(names)
            for q, (found, scores) in enumerate(_scores(queries, docs, names, k + 1)):
                rows = [found, scores, leaves[order[np.searchsorted(names, found, sorter=order)]]]
                if q in best:
                    rows = [np.concatenate(both) for both in zip(best[q], rows, strict=True)]
                first = np.lexsort((rows[0], -rows[1]))[: k + 1]
                best[q] = [x[first] for x in rows]
        for q, (found, scores, own) in best.items():
            yield pd.DataFrame({"asked": asked[q], "name": found, "score": scores, "leaves": list(own)})

    near = indexed.select("name", "v", "leaves").mapInPandas(scan, "asked long, name long, score double, leaves array<long>")
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "name")
    near = near.where("asked <> name").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    truth = near.select("asked", "leaves").toPandas()  # PROBES times k rows at most
    position = {}
    for name, query in zip(asked.tolist(), queries, strict=True):
        for at, leaf in enumerate(tree.best_bins(query), 1):
            position[name, leaf] = at
    if not len(truth):
        return 1
    needed = np.sort([min(position[a, b] for b in own) for a, own in zip(truth["asked"], truth["leaves"], strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
