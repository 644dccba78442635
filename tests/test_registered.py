"""Every registered query against its DuckDB text, values and types."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tallyhouse.checks import registry
from tallyhouse.checks.standins import StandIns

from conftest import SF

QUERIES = registry.queries()
ORACLES = registry.oracles()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    expected = duck.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in expected.description}
    assert sorted(kinds) == names
    for field in df.schema:
        kind = field.dataType.simpleString()
        assert TYPES.get(kind, kind.upper()) == kinds[field.name].replace(" ", ""), field.name
    at = [list(kinds).index(n) for n in names]
    want = Counter(repr(tuple(row[i] for i in at)) for row in expected.fetchall())
    got = Counter(repr(tuple(row[n] for n in names)) for row in df.collect())
    assert got == want


@pytest.mark.parametrize(("source", "names"), [
    ("customer", ["industry_plus_factorys", "industry_plus_test", "bg_user", "base_clients_pool", "old_accounts",
                  "req_application_decision", "req_company_admin_change", "req_account_rename"]),
    ("part", ["req_app_new"]), ("documents", ["req_learn_task_new"]),
])
def test_stand_ins_hold_all_rows(spark, source, names):
    tables = StandIns(spark, SF)
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert {name: tables[name].count() for name in names} == dict.fromkeys(names, n)
