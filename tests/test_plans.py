"""Shapes of physical plans that must hold however large the tables get."""

from __future__ import annotations

import re

import pytest

from tallyhouse.checks import registry
from tallyhouse.checks.standins import StandIns
from tallyhouse.plans import companies, operations, people
from tallyhouse.sources.tables import ParquetTables

from conftest import SF


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


REPORTS = {
    "identity_reviews": people.identity_reviews, "users": people.users, "coin_ledger": people.coin_ledger,
    "order_sales": operations.order_sales, "finance_flow": operations.finance_flow, "purchases": operations.purchases,
    "production": operations.production, "stock_ledger": operations.stock_ledger, "companies": companies.companies,
    "image_tags": operations.image_tags, "invited_companies": people.invited_companies,
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_whole_relations_never_gather_in_one_task(spark, name):
    text = plan(REPORTS[name](StandIns(spark, SF)).rows())
    assert "SinglePartition" not in text
    assert "Window" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_pages_number_only_a_limited_head(spark, name):
    text = plan(REPORTS[name](StandIns(spark, SF)).page(3, 10))
    assert "TakeOrderedAndProject(limit=30" in text
    window = text[text.index("Window"):]
    # Whatever feeds the numbering has been cut before it is gathered.
    assert re.search(r"TakeOrderedAndProject\(limit=30", window)


def test_no_python_functions_anywhere(spark):
    jobs = {}
    for name in registry.queries():
        if name[0] == "j" and not name.startswith("j18"):
            jobs.setdefault(name[:3], name)
    for name, query in registry.queries().items():
        if name in jobs.values() or name.endswith(("_all", "_total")) or name[0] in "pfu":
            text = plan(query(spark, SF))
            assert "Python" not in text and "ArrowEval" not in text, name
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    t = StandIns(spark, SF)
    for name in ("user_info", "orders", "factorys", "factory_users", "coin_records"):
        t[name].write.parquet(f"{root}/{name}")
    return ParquetTables(spark, root)


def test_filters_and_columns_reach_the_scan(spark, stored):
    text = plan(people.users(stored, id="138", stime=5, sdsd=1).rows())
    assert "StringContains(phone,138)" in text
    assert "GreaterThanOrEqual(time,5)" in text and "GreaterThanOrEqual(coin" in text
    scan = next(line for line in text.splitlines() if "factory_users" in line)
    assert "ReadSchema: struct<phone:string,factory:string>" in scan


def test_totals_drop_lookups_that_cannot_change_them(spark, stored):
    text = plan(people.coin_ledger(stored).total())
    assert "factorys" not in text
    assert text.count("FileScan") == 3
    # Both sides are counted per key before they are joined.
    assert text.index("Join") < text.index("HashAggregate(keys=[user_id")


def test_changes_never_move_the_state_when_the_batch_is_small(spark, stored):
    from pyspark.sql import functions as F

    from tallyhouse.operators import changes
    from tallyhouse.operators.scratch import written

    small = written(spark.createDataFrame([("13800000001", 5)], "phone string, added int"))
    df = changes.update(stored["user_info"], small, ["phone"], {"coin": F.col("coin") + F.col("change.added")})
    text = plan(df)
    assert "BroadcastHashJoin" in text and "hashpartitioning(phone" not in text


def test_a_job_joins_its_batch_to_unmoved_state(spark, stored):
    from tallyhouse.plans.review_jobs import grant_coins

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        batch = StandIns(spark, SF)["req_coin_grant"].limit(20)
        text = plan(grant_coins(stored, batch).table(stored, "user_info"))
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        state = text[:text.index("BroadcastExchange")]
        assert "Exchange" not in state
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
