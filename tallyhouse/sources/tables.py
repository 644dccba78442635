"""Table access: Parquet folders and live databases. Both give DataFrames under the declared schemas."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.hotkeys import combined, hot_keys, key_sketch
from tallyhouse.schema import TABLES
from tallyhouse.sources.textindex import TextIndex


class ParquetTables(Mapping[str, DataFrame]):
    """One Parquet folder per table under ``root``; partition folders below it prune as usual."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self._root = root.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self._spark.read.schema(TABLES[name]).parquet(f"{self._root}/{name}")

    def _counters(self, name: str, keys: Sequence[str]) -> str:
        return f"{self._root}/_key_counters/{name}/{'+'.join(keys)}"

    def count_keys(self, name: str, keys: Sequence[str], rows: DataFrame | None = None) -> None:
        """Keeps a sketch of the table's keys beside it; ``rows`` only adds that of rows about to be appended."""
        mode = "overwrite" if rows is None else "append"
        key_sketch(self[name] if rows is None else rows, keys).write.mode(mode).parquet(self._counters(name, keys))

    def hot_keys(self, name: str, keys: Sequence[str], rows: int) -> Mapping[int, int] | None:
        """Keys with more than ``rows`` rows by the counters beside the table; None where it has none."""
        folder = self._counters(name, keys)
        path = self._spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return hot_keys(combined(self._spark.read.parquet(folder)), rows)

    def _text_index(self, name: str) -> TextIndex:
        return TextIndex(self._spark, f"{self._root}/_text_index/{name}")

    def index_text(self, name: str, key: str, columns: Sequence[str], buckets: int = 64) -> None:
        """Makes the table's postings for substring filters on ``columns``; to be made again when the table has changed."""
        self._text_index(name).build(self[name], key, columns, buckets)

    def cut_by_text(self, name: str, texts: Mapping[str, str | None]) -> DataFrame:
        """The table, or what postings leave of it for substring filters; the filters themselves are still to be applied."""
        return self._text_index(name).cut(self[name], texts)

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def range_predicates(column: str, low: int, high: int, parts: int) -> list[str]:
    """Disjoint SQL ranges covering every value of ``column``, NULLs included, one per read task."""
    if parts < 1 or high < low:
        raise ValueError("need at least one part and low <= high")
    step = max((high - low + parts) // parts, 1)
    cuts = list(range(low + step, high + 1, step))
    if not cuts:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} < {cuts[0]}", *inner, f"{column} >= {cuts[-1]}", f"{column} IS NULL"]


def jdbc_table(
    spark: SparkSession, url: str, name: str, predicates: Sequence[str], properties: Mapping[str, str]
) -> DataFrame:
    """A live table, one query per predicate, so the read is spread over executors."""
    raw = spark.read.jdbc(url, name, predicates=list(predicates), properties=dict(properties))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
