"""Document quality by hierarchical empirical Bayes over host and path.

A logistic classifier on the shape of the text (case, symbols, repetition, word lengths) gives evidence per document; it is
fit on a bounded sample of labelled rows. Outcomes per document, its label where there is one and the classifier's
probability elsewhere, are summed by path and by host with grouped aggregation. A path's rate is shrunk to its host's and a
host's to the global rate; how strongly follows from the spread between groups (method of moments). A document's own
outcome is left out of its groups. Evidence and site odds add up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import written
from tallyhouse.llm.url_rules import url_host, url_path

SAMPLE = 20_000  # labelled documents that the classifier is fit on at most
LIMIT = 12.0  # largest log-odds of the classifier, either way

SHAPES = 12


def shape(text: str | None) -> list[float]:
    """Numbers that tell prose from junk; zeros for null, empty and blank texts."""
    words = text.split() if text else []
    if not words:
        return [0.0] * SHAPES
    counts = Counter(words)
    n, chars = len(words), len(text)
    letters = sum(map(str.isalpha, text)) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    shouted = sum(len(x) for x in lines if x.isupper())
    ends = Counter(w[-2:] for w in words if not w[-1].isalnum() and w[-2:-1] and not w[-2].isalnum())
    pairs = len(set(zip(words, words[1:], strict=False)))
    longest = max(map(len, words))
    return [
        float(np.log1p(n)), len(counts) / n, max(counts.values()) / n, pairs / max(1, n - 1),
        sum(map(str.isupper, text)) / letters, (chars - letters - text.count(" ") - text.count("\n")) / chars,
        sum(ends.values()) / n, max(ends.values(), default=0) / n, shouted / chars,
        1 - len(set(lines)) / len(lines), letters / n, float(np.log1p(longest)),
    ]


@dataclass
class Evidence:
    """A logistic model on standardised shapes."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, shapes: np.ndarray) -> np.ndarray:
        x = np.hstack([np.ones((len(shapes), 1)), (shapes - self.mean) / self.scale])
        return np.clip(x @ self.weights, -LIMIT, LIMIT)


def fit_evidence(shapes: np.ndarray, good: np.ndarray, penalty: float = 1.0, turns: int = 30) -> Evidence:
    """Newton steps on the penalised likelihood; with one kind of label, or none, the weights are zero."""
    mean, scale = (shapes.mean(axis=0), np.maximum(shapes.std(axis=0), 1e-9)) if len(shapes) else (0.0, 1.0)
    mean, scale = np.zeros(SHAPES) + mean, np.zeros(SHAPES) + scale
    weights = np.zeros(SHAPES + 1)
    if 0 < good.sum() < len(good):
        x = np.hstack([np.ones((len(shapes), 1)), (shapes - mean) / scale])
        ridge = np.diag([1e-6] + [penalty] * SHAPES)
        for _ in range(turns):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (good - p) - ridge @ weights)
            weights += np.clip(step, -2, 2)
    return Evidence(mean, scale, weights)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and first path segment of a url, from its first ``://`` on; empty where there is none."""
    return url_host(url), F.regexp_extract(url_path(url), r"^/([^/]*)", 1)


def judged(documents: DataFrame, labels: DataFrame, pages: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, host, path, evidence, quality, kept) of every document row.

    The site of a document is the url of the page with its id (the smallest, if there are several); without one, its source
    stands for the host. ``quality`` is the probability of a good document, ``kept`` whether it is at least one half. Null
    and empty texts have the shape zero and are judged like any other; null ids and sources belong to the empty site. Several
    labels of one document count by their smallest; labels other than 0 and 1 are ignored. An empty table of documents
    gives no rows; without labels or pages all are judged alike. Other columns are ignored.
    """
    told = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality")
    )
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.lower("source"), F.lit("")).alias("source")
    )

    @F.pandas_udf("array<double>")
    def shaped(texts: pd.Series) -> pd.Series:
        return pd.Series([shape(t) for t in texts])

    met = docs.join(F.broadcast(sample), "doc_id").select("quality", shaped("text").alias("shape")).toPandas()
    seen = np.array(met["shape"].tolist()).reshape(len(met), SHAPES)
    model = fit_evidence(seen, met["quality"].to_numpy())

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            shapes = np.array([shape(t) for t in own["text"]]).reshape(len(own), SHAPES)
            yield own[["doc_id", "source"]].assign(evidence=model.log_odds(shapes))

    rows = written(docs.mapInPandas(scored, "doc_id long, source string, evidence double"))
    urls = pages.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("doc_id")).agg(F.min("url").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.join(urls, "doc_id", "left").join(told, "doc_id", "left").select(
        "doc_id", F.when(F.col("url").isNull(), F.col("source")).otherwise(host).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"), "evidence",
        F.coalesce(F.col("quality").cast("double"), 1 / (1 + F.exp(-F.col("evidence")))).alias("outcome"),
    )
    return _combined(written(rows))


def _combined(rows: DataFrame) -> DataFrame:
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_path"), F.sum("outcome").alias("s_path"))
    paths = written(paths)
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    whole = hosts.agg(F.sum("n_host").alias("n"), F.sum("s_host").alias("s")).first()
    n, s = whole["n"] or 0, whole["s"] or 0.0
    overall = min(max((s + 1) / (n + 2), 1e-6), 1 - 1e-6)
    host_rate = F.col("s_host") / F.col("n_host")
    between_hosts = _strength(hosts, host_rate, F.col("n_host"), F.lit(overall))
    within = paths.join(hosts, "host")
    between_paths = _strength(within, F.col("s_path") / F.col("n_path"), F.col("n_path"), host_rate)

    out = rows.join(within, ["host", "path"])
    host = (F.col("s_host") - F.col("outcome") + between_hosts * overall) / (F.col("n_host") - 1 + between_hosts)
    path = (F.col("s_path") - F.col("outcome") + between_paths * host) / (F.col("n_path") - 1 + between_paths)
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path))
    odds = F.col("evidence") + F.log(site / (1 - site)) - float(np.log(overall / (1 - overall)))
    quality = 1 / (1 + F.exp(-odds))
    return out.select("doc_id", "host", "path", "evidence", quality.alias("quality"), (quality >= 0.5).alias("kept"))


def _strength(groups: DataFrame, rate: Column, n: Column, mean: Column) -> float:
    """Prior rows of a beta prior by the method of moments: what the spread of the rates leaves beyond chance."""
    spread = F.sum(n * (rate - mean) * (rate - mean))
    chance = F.sum(mean * (1 - mean))
    row = groups.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), spread.alias("spread"), chance.alias("chance"),
                     F.sum(n * mean * (1 - mean)).alias("total")).first()
    if not row["k"] or not row["total"]:
        return 100.0
    extra = max(row["spread"] - row["chance"], 0.0) / row["total"]  # variance between groups / m(1-m)
    return float(min(max(1 / extra - 1 if extra else 1e4, 1.0), 1e4))
