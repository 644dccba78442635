"""One key holding a large share of the rows: results stay whole and the work is split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhouse.checks.standins import StandIns
from tallyhouse.operators import hotkeys, listing, spread
from tallyhouse.operators.spread import spread_join
from tallyhouse.plans import operations, people
from tallyhouse.sources.store import write_bucketed
from tallyhouse.sources.tables import ParquetTables

from conftest import SF
from tables import HandTables


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(spread, "HOT_ROWS", 10)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def hot_tables(spark):
    return HandTables(
        spark,
        coin_records=[{"id": i, "user_id": "hot" if i % 3 else f"u{i}", "val": 1, "time": i} for i in range(90)],
        user_info=[{"phone": "hot", "name": "n"}, {"phone": "u3", "name": "same"}]
        + [{"phone": f"s{i}", "name": "same"} for i in range(45)],
        # The same membership over and over: equal rows must be split too.
        factory_users=[{"phone": "hot", "factory": "F"}] * 35 + [{"phone": "u3", "factory": "G"}, {"phone": "x", "factory": "F"}],
        factorys=[{"id": "F", "name": "f"}],
        purchase=[{"id": i, "buyer": "same" if i % 2 else "nobody", "creator": "hot" if i % 5 == 0 else "u3", "total_price": 1,
                   "material_count": 1, "time": i} for i in range(20)],
    )


@pytest.mark.parametrize("report", [people.coin_ledger, operations.purchases])
def test_spread_lookups_give_the_same_rows(spark, report, small_limits):
    t = hot_tables(spark)
    spread_rows = rows_of(report(t).rows())
    plain = report(t)
    df = plain.base
    for lookup in plain.lookups:
        df = lookup.attach(df)
    assert spread_rows == rows_of(df.select(*plain.output))
    assert len(spread_rows) == plain.total().first()["total"]


def test_hot_right_keys_end_in_several_parts(spark, small_limits):
    left = spark.range(4).select("id", F.lit("k").alias("l"))
    right = spark.range(100).select(F.lit("k").alias("r"), F.lit(1).alias("v"))
    joined = spread_join(left, right, ["l"], ["r"])
    assert joined.count() == 400
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_left_part" in text and "_right_part" in text


def test_no_hot_key_means_the_plain_join(spark):
    """Nothing is scanned or shuffled besides what a left join of the same tables does."""
    t = StandIns(spark, SF)
    for report in (people.users, people.coin_ledger, operations.finance_flow, operations.purchases, operations.stock_ledger):
        lst = report(t)
        df = lst.base
        for lookup in lst.lookups:
            df = lookup.attach(df)
        texts = [d._jdf.queryExecution().executedPlan().toString() for d in (lst.rows(), df.select(*lst.output))]
        for node in ("FileScan", "Exchange", "Join"):
            assert texts[0].count(node) == texts[1].count(node), (report, node)


@pytest.mark.parametrize("distinct", [False, True])
def test_what_the_sketch_says_changes_no_result(spark, small_limits, distinct):
    """Wrong, outdated and colliding hot keys; keys without rows; null keys; rows repeated beyond a chunk."""
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "gone")], "id int, l string")
    rows = [("a", i) for i in range(25)] + [("b", i) for i in range(3)] + [(None, 1)]
    if not distinct:
        rows += [("a", 7)] * 33
    right = spark.createDataFrame(rows, "r string, v int")
    want = rows_of(left.join(right, left["l"] == right["r"], "left"))
    numbers = {k: right.select(hotkeys.key_hash(F.lit(k))).first()[0] for k in ("a", "b", "gone", "never")}
    for names in ((), ("a",), ("b",), ("gone", "never"), ("a", "b", "gone")):
        got = spread_join(left, right, ["l"], ["r"], distinct, {numbers[n]: 5 for n in names})
        assert got.columns == ["id", "l", "r", "v"]
        assert rows_of(got) == want


def test_sketches_of_parts_combine(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 7 == 0, "y").otherwise(F.col("id").cast("string")).alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit(1)).alias("half"),
    )
    whole = hotkeys.hot_keys(hotkeys.key_sketch(df, ["k"]), 1000)
    parts = [hotkeys.key_sketch(df.where(F.spark_partition_id() % 2 == i), ["k"]) for i in (0, 1)]
    merged = hotkeys.hot_keys(hotkeys.combined(parts[0].unionByName(parts[1])), 1000)
    x, y = (df.select(hotkeys.key_hash(F.lit(k))).first()[0] for k in "xy")
    assert set(whole) == set(merged) == {x, y}
    assert abs(whole[x] - 20_000) < 200 and abs(merged[y] - 5_714) < 200
    # Rows with a null among the keys match nothing and are not counted.
    both = hotkeys.hot_keys(hotkeys.key_sketch(df, ["k", "half"]), 1000)
    assert sorted(both.values()) == sorted(r[0] for r in df.where("half = 1 and k in ('x', 'y')").groupBy("k").count().select("count").collect())
    assert hotkeys.hot_keys(hotkeys.key_sketch(df.where("false"), ["k"]), 0) == {}


def test_counters_beside_a_table(spark, small_limits, tmp_path):
    """Counted once, added to with the rows appended, and then the only thing a report asks."""
    t = hot_tables(spark)
    for name in ("coin_records", "user_info", "factory_users", "factorys"):
        t[name].write.parquet(f"{tmp_path}/{name}")
    stored = ParquetTables(spark, str(tmp_path))
    assert stored.hot_keys("factory_users", ["phone"], 10) is None
    want = rows_of(people.coin_ledger(stored).rows())
    stored.count_keys("factory_users", ["phone"])
    assert list(stored.hot_keys("factory_users", ["phone"], 10).values()) == [35]
    hotkeys._known.clear()
    assert rows_of(people.coin_ledger(stored).rows()) == want
    assert not hotkeys._known
    more = t["factory_users"].where("phone = 'hot'").withColumn("phone", F.lit("u3"))
    stored.count_keys("factory_users", ["phone"], more)
    more.write.mode("append").parquet(f"{tmp_path}/factory_users")
    assert sorted(stored.hot_keys("factory_users", ["phone"], 10).values()) == [35, 36]
    text = people.coin_ledger(stored).rows()._jdf.queryExecution().optimizedPlan().toString()
    assert "_left_part" in text


def test_hot_left_keys_are_split_at_run_time(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "2000")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2000")
    try:
        left = spark.range(20000).repartition(8).select("id", F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
        right = spark.range(1000).select(F.col("id").alias("rid"), F.lit("x").alias("v"))
        joined = left.join(right, F.col("k") == F.col("rid"), "left")
        assert len(joined.collect()) == 20000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_bucketed_tables_join_without_a_shuffle(spark, no_broadcast, tmp_path):
    t = hot_tables(spark)
    spark.sql(f"create database if not exists bucketed location '{tmp_path}'")
    try:
        write_bucketed(t["coin_records"], "bucketed.ledger", "user_id", 4)
        write_bucketed(t["user_info"], "bucketed.people", "phone", 4)
        ledger, people_ = spark.table("bucketed.ledger"), spark.table("bucketed.people")
        joined = ledger.join(people_, ledger["user_id"] == people_["phone"], "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 90
    finally:
        spark.sql("drop database bucketed cascade")


@pytest.mark.parametrize("report", [people.coin_ledger, people.users, operations.purchases, operations.stock_ledger])
def test_pages_over_hot_lookups(spark, report):
    """A page takes only the first rows of a key that has many, and they are the right ones."""
    t = dict(hot_tables(spark).items())
    t["factory_users"] = spark.range(300).select(
        F.lit("hot").alias("phone"), F.lit("m").alias("name"), F.array(F.lit("3")).alias("rights"),
        F.concat(F.lit("F"), F.lpad((F.col("id") * 7 % 300).cast("string"), 3, "0")).alias("factory"), F.lit(1).cast("bigint").alias("time"),
    )
    t["factorys"] = t["factory_users"].select(
        F.col("factory").alias("id"), F.concat(F.lit("n"), "factory").alias("name"), F.concat(F.lit("t"), "factory").alias("title"),
        F.array("phone").alias("administrators"), "time",
    )
    t["user_info"] = t["user_info"].withColumn("time", F.lit(5).cast("bigint")).withColumn("coin", F.lit(1).cast("decimal(18,2)"))
    t["material_incoming"] = t["material_incoming"].unionByName(
        spark.createDataFrame([(i, "F001", ["1"], ["2"], i, "hot") for i in range(5)], t["material_incoming"].schema)
    )
    t["materials_log"] = spark.range(200).select((F.col("id") % 2).alias("use_id"), (F.col("id") * 13 % 200).alias("time"))
    lst = report(t)
    numbered = [tuple(r) for r in lst.numbered(partitions=3).orderBy("rn").collect()]
    for page, row in ((1, 10), (4, 25), (2, 150)):
        want = numbered[(page - 1) * row:page * row]
        assert [tuple(r) for r in lst.page(page, row).collect()] == want
