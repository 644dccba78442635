"""Hand tables under the declared schemas; tables that are not given are empty."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyhouse.schema import TABLES


class HandTables(Mapping[str, DataFrame]):
    def __init__(self, spark: SparkSession, **rows: list[dict]) -> None:
        self._frames = {name: table(spark, TABLES[name], rows.get(name, [])) for name in TABLES}

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)


def table(spark: SparkSession, schema: T.StructType, rows: list[dict]) -> DataFrame:
    unknown = {k for r in rows for k in r} - set(schema.fieldNames())
    assert not unknown, unknown
    fixed = [
        tuple(
            Decimal(str(v)) if isinstance(f.dataType, T.DecimalType) and (v := r.get(f.name)) is not None else r.get(f.name)
            for f in schema
        )
        for r in rows
    ]
    return spark.createDataFrame(fixed, schema)


def requests(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def column(df: DataFrame, name: str) -> list:
    return [r[name] for r in df.collect()]
