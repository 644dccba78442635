"""The corpus pipeline: documents go through five operators, each stage's rows written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of
``documents``; the last returns token pieces with their places in training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import written
from tallyhouse.llm.mixing import mixed_documents
from tallyhouse.llm.near_dedup import near_duplicates
from tallyhouse.llm.packing import packed_documents
from tallyhouse.llm.queries import prepared, table
from tallyhouse.llm.suffix_dedup import without_repeats
from tallyhouse.llm.toxicity import fit_severity, graded

# Passages of over 50 words go. Such a passage takes 285 bytes and more in texts of European languages (5.7 a word); the
# length is set below that, so that one which starts or ends inside a word is found as well.
REPEAT_BYTES = 250


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model holds toxic go; the model learns from the labels of the documents at hand.

    Every row is judged by its text alone, repeated rows alike; a null text is an empty one and stays. No documents give none.
    """
    prepared(spark)
    model = fit_severity(docs, table(spark, sf_dir, "labels"))
    judged = graded(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return judged.where(~F.col("toxic")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once; rows without a doc_id all stay."""
    prepared(spark)
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    return once.select("row.*").unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``REPEAT_BYTES`` bytes and more that repeat go from every text that has them; the documents stay.

    Null and empty texts stay as they are, repeated rows lose their whole text, ids play no part; no documents give none.
    """
    prepared(spark)
    return without_repeats(docs, REPEAT_BYTES)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents come once for each pass over their source that takes words of them.

    Documents without words are never taken; a null source is one of its own. No documents give none.
    """
    prepared(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix in training sequences; a null text is an empty document. No documents give none."""
    prepared(spark)
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

# Trained models, hash permutations, connected components and token ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs)
    return docs
