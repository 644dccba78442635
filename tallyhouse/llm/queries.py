"""The registered queries of this subpackage, with DuckDB text where SQL can say the same."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.backoff_lm import scored
from tallyhouse.llm.decontamination import contamination
from tallyhouse.llm.kmeans_tree import nearest
from tallyhouse.llm.manifest import tampering, verified
from tallyhouse.llm.mixing import taken_words
from tallyhouse.llm.near_dedup import near_duplicates
from tallyhouse.llm.oracles import ORACLES
from tallyhouse.llm.packing import packed_documents
from tallyhouse.llm.site_quality import judged
from tallyhouse.llm.spelling import variants_of_texts
from tallyhouse.llm.suffix_dedup import removed_repeats
from tallyhouse.llm.topk import exact_top_k
from tallyhouse.llm.toxicity import fit_severity, graded
from tallyhouse.llm.url_rules import judged_urls
from tallyhouse.session import tune

Query = Callable[[SparkSession, str], DataFrame]

# Rows of an Arrow batch: whole texts travel in it.
BATCH = "500"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the operators here."""
    tune(spark)
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return spark


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; nothing happens where it came with the job."""
    context = spark.sparkContext
    if any(path.endswith("tallyhouse.zip") for path in context._python_includes):
        return
    root = Path(__file__).resolve().parents[2]
    if (root / "tallyhouse").is_dir():
        folder = tempfile.mkdtemp(prefix="tallyhouse-code-")  # on the driver, which serves it to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/tallyhouse", "zip", root, "tallyhouse"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def mixing(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(table(spark, folder, "documents"))


def exact_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))


def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document row: doc_id, severity, grade, toxic."""
    documents = table(spark, folder, "documents")
    model = fit_severity(documents, table(spark, folder, "labels"))
    return graded(documents, model).select("doc_id", "severity", "grade", "toxic")


def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"))


def site_quality(spark: SparkSession, folder: str) -> DataFrame:
    names = ("documents", "labels", "pages")
    return judged(*[table(spark, folder, name) for name in names])


def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return removed_repeats(table(spark, folder, "documents"))


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants_of_texts(table(spark, folder, "documents"))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = verified(table(spark, folder, "documents"), **tampering())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Query] = {
    "op1_source_mixing": mixing,
    "op2_exact_top_k": exact_search,
    "op3_url_rules": url_filter,
    "op4_kmeans_tree": nearest_neighbours,
    "op5_toxicity": toxicity,
    "op6_backoff_lm": lm_scores,
    "op7_site_quality": site_quality,
    "op8_near_dedup": near_dedup,
    "op9_best_fit_packing": best_fit_packing,
    "op10_suffix_dedup": suffix_dedup,
    "op11_spelling_variants": spelling_variants,
    "op12_merkle_manifest": merkle_manifest,
    "op13_decontamination": decontamination,
}

__all__ = ["ORACLES", "QUERIES", "prepared", "table"]
