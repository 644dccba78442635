"""Everything that is registered, under the session settings it is written for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.checks import job_queries, operator_queries, report_queries
from tallyhouse.session import tune

Query = Callable[[SparkSession, str], DataFrame]

_PARTS = (report_queries, job_queries, operator_queries)


def _tuned(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(tune(spark), folder)

    return run


def queries() -> dict[str, Query]:
    return {name: _tuned(query) for part in _PARTS for name, query in part.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
