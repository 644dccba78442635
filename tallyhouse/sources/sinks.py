"""Results: pages with their total, nested report documents, change messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.paging import number_rows

# Lines of a report's list that one row of a document holds.
CHUNK = 1000


def write_page(page: DataFrame, total: DataFrame, path: str, fmt: str = "json") -> None:
    """``data`` and ``total`` next to each other, as a report answers them."""
    page.write.format(fmt).save(f"{path}/data")
    total.write.format(fmt).save(f"{path}/total")


def documents(lines: DataFrame, key: Sequence[str], fields: Sequence[str], position: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(*key, chunk, items): the lines of each key as lists in the order of ``position``, ``chunk`` lines to a row.

    Lines are numbered over all keys in sorted ranges, so a key with any share of them is spread over tasks and no list
    grows with the data. Chunks count from 0; lines that tie in ``position`` have to be equal in ``fields``.
    """
    numbered = number_rows(lines, [F.asc_nulls_first(c) for c in (*key, *position)])
    numbered = numbered.select(*[F.col(c).alias(f"_line_{c}") for c in key], F.struct(*fields).alias("_item"), "rn")
    first = numbered.groupBy(*[F.col(f"_line_{c}").alias(c) for c in key]).agg(F.min("rn").alias("_first"))
    same = [numbered[f"_line_{c}"].eqNullSafe(first[c]) for c in key]
    placed = numbered.join(first, same).withColumn("chunk", F.floor((F.col("rn") - F.col("_first")) / chunk))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rn", "_item"))), lambda x: x["_item"])
    return placed.groupBy(*key, "chunk").agg(items.alias("items"))


def publish(messages: DataFrame, path: str) -> None:
    """Messages as JSON lines, one folder append per call."""
    messages.select("value").write.mode("append").text(path)


def publish_kafka(messages: DataFrame, options: Mapping[str, str]) -> None:
    """Messages to a topic; needs the Kafka connector on the class path."""
    messages.select("value").write.format("kafka").options(**options).save()
