"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are the distinct lower-cased words of a text and the first four and five letters of longer ones. From a bounded sample of
labelled documents (``SAMPLE`` rows) Spark counts the features per label and the ones that tell the labels apart best are
kept (``FEATURES`` of them at most). One weight per feature is shared by all ordered thresholds:
``P(grade <= j) = logistic(threshold_j - weights . features)``. The model is small and travels in the task; every document
is scored over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import written

SAMPLE = 20_000  # labelled documents that the model is fit on at most
FEATURES = 2048
LEAST = 5  # labelled documents that a feature is in at least
TELLING = 4.0  # standard errors between the shares of toxic and other documents that have the feature
WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5)


def features(text: str | None) -> set[str]:
    """Distinct words and, marked by a star, beginnings of long words; nothing for null and empty texts."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


@dataclass
class Severity:
    """Weights by feature and ascending thresholds between the grades 0, 1, ..."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def beyond(self, text: str | None) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        score = sum(self.weights[f] for f in sorted(self.weights.keys() & features(text)))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, n_columns: int, grades: np.ndarray, n_grades: int,
    penalty: float = 0.2, turns: int = 1500,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model; ``rows`` and ``columns`` are the places of ones.

    Gradient steps with momentum and per-parameter scale; thresholds stay ordered as a first value and positive steps.
    """
    n = len(grades)
    share = np.array([(grades <= j).mean() for j in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(start), 1e-2))
    at = np.concatenate([np.zeros(n_columns), start[:1], steps])
    first, second = np.zeros_like(at), np.zeros_like(at)

    def logistic(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    for turn in range(1, turns + 1):
        weights, head, tail = at[:n_columns], at[n_columns], np.exp(at[n_columns + 1 :])
        limits = np.concatenate([[-np.inf], head + np.concatenate([[0.0], np.cumsum(tail)]), [np.inf]])
        score = np.bincount(rows, weights[columns], n)
        upper = np.where(grades == n_grades - 1, 1.0, logistic(limits[grades + 1] - score))
        lower = np.where(grades == 0, 0.0, logistic(limits[grades] - score))
        chance = np.maximum(upper - lower, 1e-12)
        by_upper, by_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        slope = np.bincount(columns, (by_upper - by_lower)[rows], n_columns) / n + penalty / n * weights
        on_limit = np.array(
            [by_lower[grades == j + 1].sum() - by_upper[grades == j].sum() for j in range(n_grades - 1)]
        ) / n
        on_steps = np.array([on_limit[j + 1 :].sum() for j in range(n_grades - 2)]) * tail
        gradient = np.concatenate([slope, [on_limit.sum()], on_steps])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        at -= 0.05 * min(1.0, 2 - 2 * turn / turns) * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return at[:n_columns], at[n_columns] + np.concatenate([[0.0], np.cumsum(np.exp(at[n_columns + 1 :]))])


def fit_severity(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Severity:
    """The model from labelled documents: ``labels`` has doc_id and toxic (0 or 1; rows with another value are left out).

    The labels say yes or no. Severity has three grades: 0 not toxic; of the toxic documents, 2 are those with at least the
    median number of telling features, 1 the others. Without both kinds of label, or without telling features, nothing is
    held toxic, as with empty tables. Of repeated labels of one document a toxic one counts, ties in the choice of features go
    to the first in order; the threshold between 1 and 2 follows from that count, not from labels of its own.
    """
    spark = documents.sparkSession
    told = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(told), "doc_id"  # bounded by the limit
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            yield pd.DataFrame({"toxic": own["toxic"], "features": [sorted(features(t)) for t in own["text"]]})

    sample = written(
        texts.mapInPandas(run, "toxic int, features array<string>").withColumn("row", F.monotonically_increasing_id())
    )
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return Severity({}, np.array([np.inf, np.inf]))
    counts = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("toxic").alias("bad")
    )
    bad, good = F.col("bad") / toxic, (F.col("docs") - F.col("bad")) / (n - toxic)
    overall = F.col("docs") / n
    error = F.sqrt(overall * (1 - overall) * (1 / toxic + 1 / (n - toxic)))
    counts = counts.where(F.col("docs").between(LEAST, n - 1)).withColumn("z", (bad - good) / error)
    kept = counts.where(F.abs("z") >= TELLING).orderBy(F.abs("z").desc(), "feature").limit(FEATURES)
    chosen = kept.select("feature", "z").collect()  # bounded by FEATURES
    if not chosen:
        return Severity({}, np.array([np.inf, np.inf]))
    numbered = spark.createDataFrame([(r["feature"], at) for at, r in enumerate(chosen)], "feature string, at int")
    hits = sample.select("row", F.explode("features").alias("feature")).join(F.broadcast(numbered), "feature")
    # Numbers only come to the driver: two for each telling feature of a row of the bounded sample.
    ones = hits.select("row", "at").toArrow()
    told = sample.select("row", "toxic").toArrow().sort_by("row")
    columns = ones["at"].to_numpy()
    rows = np.searchsorted(told["row"].to_numpy(), ones["row"].to_numpy())
    order = np.lexsort((columns, rows))
    rows, columns = rows[order], columns[order]
    is_toxic = told["toxic"].to_numpy() == 1
    telling = np.bincount(rows, np.array([r["z"] > 0 for r in chosen], float)[columns], len(is_toxic))
    grades = is_toxic.astype(int) + (is_toxic & (telling >= np.median(telling[is_toxic])))
    weights, thresholds = fit_ordinal(rows, columns, len(chosen), grades, 3)
    return Severity({r["feature"]: float(w) for r, w in zip(chosen, weights, strict=True)}, thresholds)


def graded(documents: DataFrame, model: Severity) -> DataFrame:
    """All rows and columns of ``documents`` with ``severity`` (expected grade), ``grade`` (likeliest) and ``toxic``.

    A document is toxic when grade 0 is less likely than not. Null and empty texts have no features and are not toxic unless
    most labelled documents are. Repeated rows are graded alike; an empty table gives no rows. Columns of these three names are
    replaced.
    """

    @F.pandas_udf("severity double, grade int, toxic boolean")
    def grade(texts: pd.Series) -> pd.DataFrame:
        beyond = np.array([model.beyond(t) for t in texts]).reshape(len(texts), len(model.thresholds))
        chances = -np.diff(np.hstack([np.ones((len(beyond), 1)), beyond, np.zeros((len(beyond), 1))]), axis=1)
        return pd.DataFrame(
            {"severity": beyond.sum(axis=1), "grade": chances.argmax(axis=1).astype("int32"), "toxic": beyond[:, 0] >= 0.5}
        )

    out = documents.drop("severity", "grade", "toxic").withColumn("_graded", grade("text"))
    return out.select(*[c for c in out.columns if c != "_graded"], "_graded.*")
