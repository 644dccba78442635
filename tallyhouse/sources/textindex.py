"""Substring search over large tables: postings of three-letter grams beside the table.

A text that contains another contains its grams, so rows that hold the rarest grams of what is searched are all that can
match; the report's own ``like`` decides among them. Postings are sorted by gram, so a search reads the row groups of its
grams; rows are kept by hash of their key, so it reads the folders of the keys found. An index knows the files it was made
from and is passed over once the table has others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.scratch import written

GRAM = 3
CHOSEN = 4  # grams that are looked up, the rarest ones
SELECTIVE = 0.1  # share of the rows beyond which the table is read instead


def grams(text: Column) -> Column:
    """The distinct grams of a text; none for shorter ones and null."""
    starts = F.when(F.char_length(text) >= GRAM, F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


def needed_grams(text: str) -> set[str]:
    """Grams every match of ``like '%text%'`` has: those of the parts between its wildcards, escapes resolved."""
    parts = [""]
    for escaped, wild, plain in re.findall(r"\\(.)|([%_])|(.)", text, flags=re.DOTALL):
        if wild:
            parts.append("")
        else:
            parts[-1] += escaped or plain
    return {part[i : i + GRAM] for part in parts for i in range(len(part) - GRAM + 1)}


def fingerprint(df: DataFrame) -> str:
    return hashlib.sha256("\n".join(sorted(df.inputFiles())).encode()).hexdigest()


class TextIndex:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self._root = root

    def build(self, df: DataFrame, key: str, columns: Sequence[str], buckets: int) -> None:
        """Writes rows, postings and gram counts; ``df`` must be a plain scan. Rows without a key are always candidates."""
        bucket = F.coalesce(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), F.lit(-1))
        rows = df.withColumn("_bucket", bucket)
        rows.repartition(buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self._root}/rows")
        texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns]))
        held = rows.where("_bucket >= 0").select(F.col(key).alias("key"), F.col("_bucket").alias("bucket"), texts.alias("t"))
        posted = held.select("key", "bucket", F.col("t.column").alias("column"), F.explode(grams(F.col("t.text"))).alias("gram"))
        # Ranges over gram and key: a gram that most rows have is split.
        ordered = posted.repartitionByRange("column", "gram", "key").sortWithinPartitions("column", "gram", "key")
        ordered.write.mode("overwrite").partitionBy("column").parquet(f"{self._root}/postings")
        counts = self._spark.read.parquet(f"{self._root}/postings").groupBy("column", "gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("column", "gram").sortWithinPartitions("gram").write.mode("overwrite").partitionBy(
            "column"
        ).parquet(f"{self._root}/counts")
        # Written last: without it there is no index.
        made = df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(key).alias("key"), F.lit(fingerprint(df)).alias("files"))
        made.write.mode("overwrite").parquet(f"{self._root}/made")

    def _made(self, df: DataFrame) -> Mapping | None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._root}/made/_SUCCESS")
        if not path.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(path):
            return None
        made = self._spark.read.parquet(f"{self._root}/made").first()
        return made if made["files"] == fingerprint(df) else None

    def _rarest(self, texts: Mapping[str, str | None], rows: int) -> tuple[str, list[str]] | None:
        """The column to search and its rarest grams; None where no text is selective."""
        best: tuple[int, str, list[str]] | None = None
        counts = self._spark.read.parquet(f"{self._root}/counts")
        for column, text in texts.items():
            wanted = needed_grams(text or "")
            if not wanted:
                continue
            # One row per gram of the text that is searched.
            found = counts.where((F.col("column") == column) & F.col("gram").isin(list(wanted))).select("n", "gram").collect()
            sizes = {gram: 0 for gram in wanted} | {gram: n for n, gram in found}
            chosen = sorted(wanted, key=lambda gram: (sizes[gram], gram))[:CHOSEN]
            if best is None or sizes[chosen[0]] < best[0]:
                best = (sizes[chosen[0]], column, chosen)
        if best is None or best[0] > SELECTIVE * rows:
            return None
        return best[1], best[2]

    def cut(self, df: DataFrame, texts: Mapping[str, str | None]) -> DataFrame:
        """Rows of ``df`` among which are all that contain the texts; ``df`` itself where the index is of no use."""
        made = self._made(df)
        rarest = made and self._rarest(texts, made["rows"])
        if not rarest:
            return df
        column, chosen = rarest
        posted = self._spark.read.parquet(f"{self._root}/postings")
        posted = posted.where((F.col("column") == column) & F.col("gram").isin(chosen))
        keys = posted.groupBy("bucket", "key").agg(F.count_distinct("gram").alias("held")).where(F.col("held") == len(chosen))
        keys = written(keys.select("bucket", "key"))
        buckets = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # no more than there are folders
        rows = self._spark.read.parquet(f"{self._root}/rows")
        met = rows.where(F.col("_bucket").isin(buckets)).join(keys, rows[made["key"]] == keys["key"], "left_semi")
        return met.unionByName(rows.where(F.col("_bucket") == -1)).select(*df.columns)
