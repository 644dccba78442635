"""Numbering and paging: pages make up the relation, whichever way they are computed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhouse.checks.standins import StandIns
from tallyhouse.operators import listing, paging, ranks, scratch
from tallyhouse.operators.paging import newest_first, number_rows
from tallyhouse.plans import operations, people

from conftest import SF
from tables import HandTables


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("report", [people.coin_ledger, operations.purchases, operations.finance_flow])
def test_pages_make_up_the_relation(spark, report):
    t = StandIns(spark, SF)
    lst = report(t)
    total = lst.total().first()["total"]
    numbered = rows_of(lst.numbered(partitions=5).orderBy("rn"))
    assert [r[-1] for r in numbered] == list(range(1, total + 1))
    row = total // 3 + 1
    paged = [r for p in (1, 2, 3) for r in rows_of(lst.page(p, row))]
    assert paged == numbered
    assert sorted(map(repr, rows_of(lst.rows()))) == sorted(repr(r[:-1]) for r in numbered)


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    t = StandIns(spark, SF)
    shallow = rows_of(operations.stock_ledger(t).page(4, 50))
    monkeypatch.setattr(listing, "DEEP_PAGE", 10)
    assert rows_of(operations.stock_ledger(t).page(4, 50)) == shallow


def hot_time(spark):
    """Tables in which a third of the rows share one time, some have none, and lookups multiply some rows."""
    rows = [{"id": i, "user_id": f"u{i % 5}", "val": 1, "time": None if i % 9 == 0 else 7 if i % 3 else 1000 * i - 40_000} for i in range(150)]
    return HandTables(
        spark, coin_records=rows, user_info=[{"phone": f"u{i}", "name": f"n{i}"} for i in range(4)],
        factory_users=[{"phone": f"u{i}", "factory": f"F{j}"} for i in range(5) for j in range(i)],
        factorys=[{"id": "F1", "name": "f"}],
    )


@pytest.mark.parametrize(
    ("enough", "filters", "pages"),
    [(1, {}, ((3, 20), (40, 9))), (20, {"name": "n"}, ((1, 7), (2, 100))), (20, {"factory_id": "F1"}, ((2, 15),))],
)
def test_pages_by_rank(spark, monkeypatch, enough, filters, pages):
    """Narrowing over nulls, ties, several columns and rows that stand for several; filters on lookups of both kinds."""
    monkeypatch.setattr(ranks, "ENOUGH", enough)
    monkeypatch.setattr(ranks, "BUCKETS", 4)
    lst = people.coin_ledger(hot_time(spark), **filters)
    numbered = rows_of(lst.numbered(partitions=3).orderBy("rn"))
    for page, row in pages:
        assert rows_of(lst.page_by_rank(page, row)) == numbered[(page - 1) * row : page * row], (page, row)


@pytest.mark.parametrize("report", [operations.stock_ledger, operations.finance_flow])
def test_pages_by_rank_of_reports(spark, monkeypatch, report):
    monkeypatch.setattr(ranks, "ENOUGH", 50)
    lst = report(StandIns(spark, SF))
    numbered = rows_of(lst.numbered(partitions=5).orderBy("rn"))
    page, row = 3, len(numbered) // 7 + 1
    assert rows_of(lst.page_by_rank(page, row)) == numbered[(page - 1) * row : page * row]


def test_a_deep_page_writes_keys_and_its_own_rows_only(spark, monkeypatch):
    """The whole joined relation is never written: only narrow keys, and rows about as many as the page has."""
    frames = []

    def watched(df):
        out = scratch.written(df)
        frames.append((set(df.columns), out.count()))
        return out

    for module in (listing, ranks, paging):
        monkeypatch.setattr(module, "written", watched)
    monkeypatch.setattr(ranks, "ENOUGH", 50)
    lst = people.coin_ledger(StandIns(spark, SF))
    assert len(lst.page_by_rank(30, 20).collect()) == 20
    base = {"time", "id", "_rows"}
    whole = [columns for columns, n in frames if n > 100]
    assert whole == [base]


def test_the_filter_of_a_deep_page_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") * 10).alias("time")).write.parquet(f"{tmp_path}/t")
    keys = spark.read.parquet(f"{tmp_path}/t").withColumn("_rows", F.lit(1).cast("bigint"))
    cut = ranks._narrowed(keys, "time", True, True, ranks.Cut(None, 0, 1000), 500, 503)[0]
    assert cut.skipped <= 500 and cut.skipped + cut.held >= 503 and cut.held <= 5
    text = cut.of(keys)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time," in text and "LessThanOrEqual(time," in text


def test_ranks_of_the_widest_numbers(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ENOUGH", 1)
    values = [-(2**63), -5, 0, 1, 2**62, 2**63 - 1, None, 3, 4]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "time long, id long").withColumn("_rows", F.lit(1).cast("bigint"))
    order = sorted(values, key=lambda v: (v is not None, -(v or 0)))
    for at in range(len(values)):
        cut = ranks.cut_for(df, newest_first("time", "id"), at, at + 1)
        found = [r["time"] for r in cut.of(df).collect()]
        assert (found, cut.skipped, cut.held) == ([order[at]], at, 1)


def test_numbering_with_one_time_for_almost_every_row(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("time"))
    order = newest_first("time", "id")
    numbered = number_rows(df, order.columns(), partitions=8)
    got = [r["id"] for r in numbered.orderBy("rn").collect()]
    assert [r["rn"] for r in numbered.orderBy("rn").collect()] == list(range(1, 5001))
    want = sorted(range(5000), key=lambda i: (-(i if i % 100 == 0 else 7), i))
    assert got == want
    # The tied time is spread over ranges by the key.
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 5000 // 2 or len(sizes) == 1


def test_empty_relation(spark):
    lst = people.coin_ledger(HandTables(spark))
    assert lst.page().collect() == [] and lst.numbered().collect() == []
    assert lst.total().first()["total"] == 0


def test_total_of_a_key_that_holds_most_rows(spark):
    t = HandTables(
        spark,
        coin_records=[{"id": i, "user_id": "hot" if i % 3 else str(i), "val": 1, "time": i} for i in range(300)],
        user_info=[{"phone": "hot", "name": "n"}, {"phone": "3", "name": "n"}],
        factory_users=[{"phone": "hot", "factory": f"F{i}"} for i in range(4)],
    )
    lst = people.coin_ledger(t)
    assert lst.total().first()["total"] == lst.rows().count() == 200 * 4 + 100
