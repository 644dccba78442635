"""Versioned tables, sinks, message streams, and request streams that end in the same state as one batch."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.checks.standins import StandIns
from tallyhouse.constants import TIME_ZONE
from tallyhouse.operators.paging import row_total
from tallyhouse.plans import companies, operations, people, review_jobs
from tallyhouse.plans.content_jobs import decode_image_payloads, write_images
from tallyhouse.plans.jobs import commit
from tallyhouse.sources import sinks
from tallyhouse.sources.store import CHANGE_MESSAGES, REQUEST_LOG, StaleSnapshot, TableStore, partition_by_day
from tallyhouse.sources.tables import ParquetTables, range_predicates
from tallyhouse.streaming import messages
from tallyhouse.streaming.apply import OTHER_REQUEST, apply_requests, apply_stream

from conftest import SF
from tables import HandTables, requests


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def new_store(spark, path, *names):
    store = TableStore(spark, str(path))
    t = StandIns(spark, SF)
    store.commit(store.snapshot(), replaced={n: t[n] for n in names})
    return store


def test_snapshots_stay_what_they_were(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.snapshot().commit == 0 and store.snapshot()["bg_banner"].count() == 0
    t = HandTables(spark, bg_banner=[{"id": "a", "image": "x", "state": "1", "time": 1}])
    first = store.commit(store.snapshot(), replaced={"bg_banner": t["bg_banner"]})
    second = store.commit(first, appended={"bg_banner": t["bg_banner"].withColumn("id", F.lit("b"))})
    third = store.commit(second, replaced={"bg_banner": second["bg_banner"].where("id = 'b'")})
    assert [s["bg_banner"].count() for s in (first, second, third)] == [1, 2, 1]
    assert store.snapshot().commit == 3 and [r["id"] for r in store.snapshot()["bg_banner"].collect()] == ["b"]
    assert len(second.folders["bg_banner"]) == 2
    fourth = store.commit(third, appended={"bg_banner": t["bg_banner"]})
    assert len(fourth.folders["bg_banner"]) == 2
    compacted = store.compact(fourth, "bg_banner")
    assert len(compacted.folders["bg_banner"]) == 1 and compacted["bg_banner"].count() == 2


def test_a_job_commits_all_tables_log_and_messages_together(spark, tmp_path):
    store = new_store(spark, tmp_path, "user_info", "coin_records")
    base = store.snapshot()
    batch = StandIns(spark, SF)["req_coin_grant"]
    result = review_jobs.grant_coins(base, batch)
    after = commit(store, base, result)
    assert after.commit == base.commit + 1
    log = after[REQUEST_LOG]
    assert log.count() == batch.count()
    granted = log.where("reason is null").count()
    assert after[CHANGE_MESSAGES].count() == granted
    assert after["coin_records"].count() == base["coin_records"].count() + granted
    added = after["coin_records"].where("from_type = 'system'").agg(F.sum("val")).first()[0]
    grown = after["user_info"].agg(F.sum("coin")).first()[0] - base["user_info"].agg(F.sum("coin")).first()[0]
    assert added == grown


def test_repeated_requests_change_nothing(spark, tmp_path):
    store = new_store(spark, tmp_path, "user_info", "coin_records")
    batch = StandIns(spark, SF)["req_coin_grant"]
    apply_requests(store, batch, review_jobs.grant_coins)
    once = {n: rows_of(store.snapshot()[n]) for n in ("user_info", "coin_records", REQUEST_LOG)}
    apply_requests(store, batch.unionByName(batch), review_jobs.grant_coins)
    assert {n: rows_of(store.snapshot()[n]) for n in once} == once


def test_different_requests_of_one_id(spark, tmp_path):
    """The earliest counts however they arrive, the others are logged; deliveries of one request are one."""
    t = HandTables(spark, user_info=[{"phone": "13800000001", "name": "n", "coin": 0, "time": 1}])
    ddl = "req_id long, phone string, dsd_val decimal(18,2), req_time long"
    rows = [(1, "13800000001", Decimal(9), 5), (1, "13800000001", Decimal(7), 3), (1, "13800000001", Decimal(8), 3)]
    rows += [(2, "13800000001", Decimal(100), 4)] * 3
    for i, arriving in enumerate((rows, rows[::-1])):
        store = TableStore(spark, f"{tmp_path}/{i}")
        store.commit(store.snapshot(), replaced={"user_info": t["user_info"]})
        apply_requests(store, requests(spark, ddl, arriving), review_jobs.grant_coins)
        after = store.snapshot()
        assert sorted(r["val"] for r in after["coin_records"].collect()) == [7, 100]
        assert after["user_info"].first()["coin"] == 107
        log = sorted((r["req_id"], r["reason"] or "") for r in after[REQUEST_LOG].collect())
        assert log == [("1", ""), ("1", OTHER_REQUEST), ("1", OTHER_REQUEST), ("2", "")]


@pytest.mark.parametrize(
    ("job", "batch", "tables"),
    [
        (review_jobs.grant_coins, "req_coin_grant", ("user_info", "coin_records")),
        (review_jobs.review_identity, "req_identity_review", ("user_info", "user_auth")),
    ],
)
def test_stream_ends_where_the_batch_ends(spark, tmp_path, job, batch, tables):
    t = StandIns(spark, SF)
    arriving = t[batch]
    # Three files whose requests follow each other in time.
    cuts = arriving.approxQuantile("req_time", [0.33, 0.66], 0.0)
    third = F.when(F.col("req_time") <= cuts[0], 0).when(F.col("req_time") <= cuts[1], 1).otherwise(2)
    for i in range(3):
        arriving.where(third == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/arriving")
    store = new_store(spark, tmp_path / "store", *tables)
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/arriving")
    query = apply_stream(store, stream, job, f"{tmp_path}/checkpoint")
    query.awaitTermination(300)
    assert query.exception() is None
    expected = job(t, arriving)
    after = store.snapshot()
    assert after.commit == 4
    for name in tables:
        assert rows_of(after[name]) == rows_of(expected.table(t, name))
    assert after[CHANGE_MESSAGES].count() == expected.messages.count()
    # A micro-batch that comes again is recognised.
    source = f"stream:{job.__name__}:{tmp_path}/checkpoint"
    assert store.has_batch(source, 2) and not store.has_batch(source, 3)
    apply_requests(store, arriving, job, source, 2)
    assert store.snapshot().commit == 4


def test_messages_survive_publishing_and_routing(spark, tmp_path):
    t = HandTables(spark, user_info=[{"phone": "13800000001", "coin": 1}])
    batch = requests(spark, "req_id long, phone string, dsd_val decimal(18,2), req_time long", [(1, "13800000001", Decimal("2.50"), 1)])
    sinks.publish(review_jobs.grant_coins(t, batch).messages, f"{tmp_path}/feed")
    drift = [
        '{"resource":"BgFacsModify","type":"POST","params":{"id":"F","name":"n","title":"t","administrators":["1","2"]}}',
        '{"resource":"BgFacsModify","type":"POST","params":{"id":"G","name":"n","title":"t","administrators":"3"}}',
        '{"resource":"BgXDImagesTag","type":"PUT","params":{"id":17,"res":"1","err_reason":""}}',
        '{"resource":"BgXDImagesTag","type":"PUT","params":{"id":"18","res":"0","err_reason":"r"}}',
        '{"resource":"BgExamine","type":"POST","params":{"state":"3","id":"111","state_msg":"\\u606d"}}',
        '{"resource":"Other","type":"POST","params":{}}', "not json", '{"resource":"BgAuth","type":"POST"}',
    ]
    spark.createDataFrame([(d,) for d in drift], "value string").write.mode("append").text(f"{tmp_path}/feed")
    query = messages.route(messages.read_messages(spark, f"{tmp_path}/feed", 1), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(300)
    assert query.exception() is None

    def table(kind):
        return [r.asDict() for r in spark.read.parquet(f"{tmp_path}/out/{kind}").drop("batch").collect()]

    assert table("BgDSDGrant") == [{"type": "POST", "id": "13800000001", "dsd_val": 2.5}]
    assert {r["id"]: r["administrators"] for r in table("BgFacsModify")} == {"F": ["1", "2"], "G": ["3"]}
    assert {r["id"] for r in table("BgXDImagesTag")} == {"17", "18"}
    assert table("BgExamine") == [{"type": "POST", "id": "111", "state": 3, "state_msg": "恭"}]
    assert len(table("rejects")) == 3


def test_reply_message_quotes(spark):
    t = HandTables(spark, user_feedback=[{"id": 1, "phone": "p", "content": "c", "time": 1}])
    batch = requests(spark, "req_id long, id long, msg string, req_time long", [(1, 1, "it's \\'x\\' \\\"y\\\"", 1)])
    result = review_jobs.reply_feedback(t, batch)
    assert result.table(t, "user_feedback").first()["resp"] == "it's \\'x\\' \\\"y\\\""
    assert json.loads(result.messages.first()["value"])["params"]["msg"] == "it''s ''x'' \"y\""


def test_a_stale_writer_fails(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    base = store.snapshot()
    rows = spark.createDataFrame([("a", "1", None)], "job string, req_id string, reason string")
    store.commit(base, appended={"request_log": rows})
    with pytest.raises(StaleSnapshot):
        store.commit(base, appended={"request_log": rows})
    assert store.snapshot().commit == 1
    assert store.snapshot()["request_log"].count() == 1


def test_page_sink_and_nested_lists(spark, tmp_path):
    t = StandIns(spark, SF)
    report = operations.order_sales(t)
    page = report.page(1, 5)
    sinks.write_page(page, report.total(), f"{tmp_path}/page")
    assert spark.read.json(f"{tmp_path}/page/data").count() == 5
    assert spark.read.json(f"{tmp_path}/page/total").first()["total"] == t["orders"].count()
    lines = operations.order_lines(t, page)
    nested = sinks.documents(lines, ["order_id"], operations.LINE_FIELDS, operations.LINE_FIELDS)
    assert sum(len(r["items"]) for r in nested.collect()) == lines.count()


def test_lists_of_any_length(spark):
    lines = spark.range(250_000).selectExpr("id % 10 div 9 as k", "id as n")
    rows = sinks.documents(lines.repartition(6), ["k"], ["n"], ["n"], chunk=40_000).collect()
    for k in (0, 1):
        own = [i["n"] for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["chunk"]) for i in r["items"]]
        assert own == [n for n in range(250_000) if n % 10 // 9 == k]
    assert max(len(r["items"]) for r in rows) == 40_000


def test_day_folders_prune(spark, tmp_path):
    log = StandIns(spark, SF)["user_activity_log"]
    partition_by_day(log, "time", f"{tmp_path}/log", TIME_ZONE)
    back = spark.read.parquet(f"{tmp_path}/log")
    assert back.count() == log.count()
    text = back.where("day >= date'2024-01-25'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in text


def test_time_windows_read_only_their_days(spark, tmp_path):
    """Reports over tables in day folders: the same rows, and a partition filter in every scan with a time window."""
    t, as_of = StandIns(spark, SF), 1706500000
    names = ("user_activity_log", "user_feedback", "user_auth", "bg_examine", "user_info")
    for name in names:
        odd = t[name].limit(3).withColumn("time", F.lit(None).cast("long")).unionByName(t[name].limit(2).withColumn("time", F.lit(-5).cast("long")))
        partition_by_day(t[name].unionByName(odd), "time", f"{tmp_path}/{name}", TIME_ZONE)
    tables = {name: t[name] for name in t}
    stored = {**tables, **{name: ParquetTables(spark, str(tmp_path))[name] for name in names}}
    flat = {**stored, **{name: stored[name].drop("day") for name in names}}
    low, high = 1704100000, 1706000000
    spread = t["bg_examine"].agg(F.expr("percentile(time, array(0.3, 0.6))").alias("p")).first()["p"]
    reports = {
        "user_activity_log": lambda x: people.active_users_daily(x, as_of),
        "user_info": lambda x: people.users(x, stime=int(spread[0]), etime=int(spread[1])).rows(),
        "user_feedback": lambda x: people.feedback(x, stime=low, etime=high).rows(),
        "user_auth": lambda x: people.identity_reviews(x, start=low, endt=high).rows(),
        "bg_examine": lambda x: companies.company_applications(x, stime=int(spread[0]), etime=int(spread[1])).rows(),
    }
    for name, report in reports.items():
        assert sorted(map(repr, report(stored).collect())) == sorted(map(repr, report(flat).collect())), name
        text = report(stored)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*day#\d+ >=", text), name
    figures = people.user_figures(stored, as_of)
    assert figures.collect() == people.user_figures(flat, as_of).collect()
    assert re.search(r"PartitionFilters: \[[^]]*day#\d+ >=", figures._jdf.queryExecution().executedPlan().toString())
    # Limits that are no dates, and none at all, prune nothing and lose nothing.
    for stime, etime in ((0, None), (-10, 10**15)):
        assert people.feedback(stored, stime=stime, etime=etime).rows().count() == people.feedback(flat, stime=stime, etime=etime).rows().count()


def test_images_are_written_by_environment(spark, tmp_path):
    t = StandIns(spark, SF)
    images = decode_image_payloads(t["req_upload"], "req_id", "payload")
    write_images(images, f"{tmp_path}/images", "prod")
    stored = spark.read.parquet(f"{tmp_path}/images")
    assert stored.count() == images.where("image_id is not null").count()
    assert {r["environment"] for r in stored.select("environment").distinct().collect()} == {"prod"}
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    joined = stored.join(texts, stored["owner"] == texts["doc_id"]).where("owner % 6 > 1")
    assert joined.where(F.decode("content", "UTF-8") != F.col("text")).count() == 0


@pytest.mark.parametrize(("low", "high", "parts"), [(0, 99, 4), (5, 5, 3), (-10, 10, 7), (0, 3, 1)])
def test_range_predicates_cover_every_value_once(low, high, parts):
    import duckdb

    conditions = range_predicates("x", low, high, parts)
    hits = " + ".join(f"coalesce(cast({c.replace('x', 'v')} as integer), 0)" for c in conditions)
    values = ", ".join([f"({v})" for v in range(low - 3, high + 4)] + ["(null)"])
    counts = {r[0] for r in duckdb.sql(f"select {hits} from (values {values}) t(v)").fetchall()}
    assert counts == {1}


def test_fixed_small_frames(spark):
    assert [r["key"] for r in companies.permission_catalogue(spark).collect()] == ["3", "5", "7", "8", "9"]
    series = people.city_series(spark)
    assert series.columns == ["city", "num"] and series.count() == 0
    assert row_total(series).first()["total"] == 0
