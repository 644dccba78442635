"""One small hand table per semantic trap, expected rows written from the definition."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import arrays, days, predicates, values
from tallyhouse.plans import companies, operations, people

from tables import HandTables, column, requests


def test_nulls_come_first_and_ties_follow_the_key(spark):
    t = HandTables(spark, bg_banner=[
        {"id": "b", "time": 5}, {"id": "a", "time": 5}, {"id": "n", "time": None}, {"id": "z", "time": 9},
    ])
    rows = operations.banners(t).page(1, 10).collect()
    assert [(r["id"], r["rn"]) for r in rows] == [("n", 1), ("z", 2), ("a", 3), ("b", 4)]


def test_page_bounds(spark):
    t = HandTables(spark, bg_banner=[{"id": str(i), "time": i} for i in range(7)])
    report = operations.banners(t)
    assert column(report.page(2, 3), "rn") == [4, 5, 6]
    assert column(report.page(3, 3), "rn") == [7]
    assert column(report.page(0, 3), "rn") == [1, 2, 3]
    assert column(report.page(1, 0), "rn") == []
    with pytest.raises(ValueError):
        report.page(1, -1)


def test_empty_filter_still_drops_nulls_where_it_is_always_applied(spark):
    t = HandTables(
        spark,
        user_auth=[{"phone": "1", "name": None, "time": 1}, {"phone": "2", "name": "b", "time": 2}],
        tp_apps=[{"id": "1", "name": None}, {"id": "2", "name": "b"}],
    )
    assert column(people.identity_reviews(t).rows(), "id") == ["2"]
    assert sorted(column(operations.apps(t).rows(), "id")) == ["1", "2"]


def test_missing_lower_time_limit_is_zero_not_absent(spark):
    t = HandTables(spark, user_info=[
        {"phone": "1", "name": "a", "time": None}, {"phone": "2", "name": "a", "time": -5}, {"phone": "3", "name": "a", "time": 0},
    ])
    assert column(people.users(t).rows(), "phone") == ["3"]


@pytest.mark.parametrize(
    ("text", "matches"),
    [
        ("a_c", ["abc", "a_c"]), (r"a\_c", ["a_c"]), ("%", ["abc", "a_c", "50%", "q\\x", "xbc"]), (r"0\%", ["50%"]),
        (r"\x\b", ["xbc"]), ("\\\\", ["q\\x"]), ("nope", []),
    ],
)
def test_like_wildcards_and_backslash(spark, text, matches):
    df = spark.createDataFrame([("abc",), ("a_c",), ("50%",), ("q\\x",), ("xbc",), (None,)], "s string")
    assert column(predicates.keep(df, predicates.contains(F.col("s"), text)), "s") == matches


def test_filter_text_is_a_value_not_sql(spark):
    df = spark.createDataFrame([("o'neil",), ("x",)], "s string")
    assert column(predicates.keep(df, predicates.contains(F.col("s"), "o'n")), "s") == ["o'neil"]


def test_right_side_filter_makes_the_join_inner(spark):
    t = HandTables(
        spark,
        user_info=[{"phone": "1", "name": "ann"}],
        user_xd_image_tag=[{"id": 1, "phone": "1", "time": 1}, {"id": 2, "phone": "unknown", "time": 2}],
    )
    assert column(operations.image_tags(t).rows(), "id") == [1]
    assert operations.image_tags(t).total().first()["total"] == 1


def test_name_filter_after_numbering_skips_numbers(spark):
    users = [{"phone": f"p{i}", "name": "match" if i % 3 == 0 else "other"} for i in range(9)]
    members = [{"phone": f"p{i}", "rights": ["3"], "factory": "F", "time": 100 - i} for i in range(9)]
    t = HandTables(spark, user_info=users, factory_users=members, factorys=[{"id": "F", "title": "T"}])
    admins = companies.company_admins(t, "F", username="match")
    assert column(admins.page(1, 2), "rn") == [1, 4]
    assert column(admins.page(2, 2), "rn") == [4, 7]
    assert admins.total().first()["total"] == 3


def test_rights_comparison_is_on_the_whole_list_and_drops_nulls(spark):
    members = [
        {"phone": "a", "rights": ["1"], "factory": "F", "time": 1}, {"phone": "b", "rights": ["1", "3"], "factory": "F", "time": 2},
        {"phone": "c", "rights": None, "factory": "F", "time": 3}, {"phone": "d", "rights": [], "factory": "F", "time": 4},
    ]
    t = HandTables(spark, factory_users=members, factorys=[{"id": "F", "title": "T", "administrators": ["a"], "time": 1}])
    assert sorted(column(companies.company_admins(t, "F").rows(), "phone")) == ["b", "d"]
    assert companies.companies(t).rows().first()["normal_admin"] == 2


def test_shown_totals_ignore_filters_or_test_another_table(spark):
    t = HandTables(
        spark,
        coin_records=[{"id": 1, "user_id": "1", "val": 1, "time": 1}, {"id": 2, "user_id": "2", "val": 1, "time": 2}],
        user_info=[{"phone": "1", "name": "ann"}],
        factory_users=[
            {"phone": "1", "name": "bob", "factory": "F"}, {"phone": "1", "name": "bob", "factory": "G"},
            {"phone": "2", "name": "ann", "factory": "F"}, {"phone": "2", "name": "ann", "factory": "G"},
        ],
        product_task=[{"id": 1, "creator": "1"}, {"id": 2, "creator": "9"}],
    )
    ledger = people.coin_ledger(t, name="ann")
    assert ledger.rows().count() == ledger.total().first()["total"] == 2
    assert people.coin_ledger(t).total().first()["total"] == 3
    assert people.coin_ledger_shown_total(t).first()["total"] == 4
    assert people.coin_ledger_shown_total(t, name="bob").first()["total"] == 2
    made = operations.production(t, name="ann")
    assert made.total().first()["total"] == 1
    assert operations.production_shown_total(t).first()["total"] == 2


def test_keyword_lists_keep_nulls_and_order(spark):
    t = HandTables(
        spark,
        xd_image_keyword=[{"id": 1, "keyword": "one"}, {"id": 2, "keyword": None}],
        xd_learn_task=[
            {"id": 1, "keyword_ids": ["9", "1", "2", "1"]}, {"id": 2, "keyword_ids": None}, {"id": 3, "keyword_ids": []},
        ],
    )
    tags = {r["id"]: r["tags"] for r in operations.learn_tasks(t).collect()}
    assert tags == {1: [None, "one", None, "one"], 2: None, 3: None}


def test_pairs_stop_at_the_shorter_list(spark):
    df = spark.createDataFrame([(["a", "b"], ["1", "2", "3"]), (["a"], None), ([], ["1"])], "l array<string>, r array<string>")
    pairs = column(df.select(arrays.zip_shortest(F.col("l"), F.col("r"), "item", "number").alias("p")), "p")
    assert [None if p is None else [tuple(x) for x in p] for p in pairs] == [[("a", "1"), ("b", "2")], None, []]


def test_array_text_shows_nulls_as_stars(spark):
    df = spark.createDataFrame([(["a", None, "b"],), (None,)], "l array<string>")
    assert column(df.select(arrays.array_text(F.col("l")).alias("t")), "t") == ["a,*,b", None]


def test_money_rounds_half_to_even(spark):
    df = spark.createDataFrame([(Decimal("0.125"),), (Decimal("0.135"),), (Decimal("-0.125"),)], "x decimal(10,3)")
    assert column(df.select(values.money(F.col("x")).alias("m")), "m") == [Decimal("0.12"), Decimal("0.14"), Decimal("-0.12")]


def test_division_by_zero_and_nulls_give_null(spark):
    t = HandTables(spark, purchase=[
        {"id": 1, "material_count": 0, "total_price": 5, "time": 2}, {"id": 2, "material_count": None, "total_price": 5, "time": 1},
        {"id": 3, "material_count": 2, "total_price": 5, "time": 0},
    ])
    assert column(operations.purchases(t).page(), "price") == [None, None, 2.5]


def test_null_times_take_the_unrewarded_branch(spark):
    after = 1552665601
    t = HandTables(
        spark,
        user_info=[
            {"phone": "a", "invitor_id": "z", "time": 1552665600}, {"phone": "b", "invitor_id": "z", "time": after, "auth_state": 3},
            {"phone": "c", "invitor_id": "z", "time": None, "auth_state": 3}, {"phone": "d", "invitor_id": "z", "time": after, "auth_state": 3},
            {"phone": "e", "invitor_id": "z", "time": after, "auth_state": 3}, {"phone": "f", "invitor_id": None, "time": 1},
        ],
        user_auth=[
            {"phone": "b", "time": after + 2592000}, {"phone": "c", "time": 5}, {"phone": "d", "time": after + 2592001},
            {"phone": "e", "time": 0},
        ],
        bg_examine=[
            {"id": "a", "time": None, "state": None}, {"id": "b", "time": after + 5184000, "state": "3"},
            {"id": "d", "time": after, "state": "2"}, {"id": "e", "time": None, "state": "3"}, {"id": "f", "time": 1, "state": "3"},
        ],
    )
    friends = {r["invited_phone"]: r["reward"] for r in people.invited_friends(t).rows().collect()}
    assert friends == {"a": "0", "b": "0", "c": "1", "d": "1", "e": "1"}
    rewards = sorted((r["time"], r["reward"]) for r in people.invited_companies(t).rows().collect())
    assert rewards == [(1552665600, "0"), (after, "0"), (after, "1"), (after, "1")]


def test_day_buckets_follow_the_business_zone_not_the_session(spark):
    df = spark.createDataFrame([(1552838399,), (1552838400,)], "t bigint")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session)
            assert column(df.select(days.day_text(F.col("t")).alias("d")), "d") == ["2019-03-17", "2019-03-18"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_daily_windows_are_strict_and_zero_filled(spark):
    start = days.day_start(1552867200, 9)
    t = HandTables(
        spark,
        user_info=[{"phone": "a", "time": start}, {"phone": "b", "time": start + 1}, {"phone": None, "time": start + 2}],
        user_activity_log=[{"phone": "a", "time": 1552867200 - 10 * 86400 + 1}, {"phone": "a", "time": 1552867200}],
    )
    new = people.new_users_daily(t, 1552867200).collect()
    assert [r["date"] for r in new] == [f"2019-03-{d:02d}" for d in range(18, 8, -1)]
    assert [r["num"] for r in new] == [0] * 9 + [1]
    assert [r["num"] for r in people.active_users_daily(t, 1552867200).collect()] == [1] + [0] * 9


def test_no_users_gives_rate_zero(spark):
    row = people.user_figures(HandTables(spark), 1552867200).first()
    assert (row["total_users"], row["new_users"], row["active_users"], row["active_rate"]) == (0, 0, 0, Decimal("0.00"))


@pytest.mark.parametrize(
    ("phone", "ok"),
    [
        ("13800000000", True), ("15,00000000", True), ("15400000000", False), ("12000000000", False), ("1380000000", False),
        ("138000000000", False), ("13800000000\n", True), ("", False), (None, False), ("16600000000", True), ("16500000000", False),
    ],
)
def test_phone_format(spark, phone, ok):
    df = spark.createDataFrame([(phone,)], "p string")
    assert df.select(predicates.is_phone(F.col("p")).alias("ok")).first()["ok"] is ok


def test_falsy_values_show_as_null_or_blank(spark):
    t = HandTables(
        spark, user_auth=[{"phone": "1", "name": "a", "time": 0}], user_info=[{"phone": "1", "name": None, "auth_state": 0}]
    )
    row = people.identity_reviews(t).rows().first()
    assert (row["time"], row["state"], row["username"], row["type"], row["image1"]) == (None, None, "", "", "")


def test_bad_review_state_is_refused(spark):
    with pytest.raises(ValueError):
        people.identity_reviews(HandTables(spark), state="9")


def test_name_joins_multiply_rows_in_page_and_total(spark):
    t = HandTables(
        spark,
        purchase=[{"id": 1, "buyer": "ann", "creator": "p", "total_price": 1, "material_count": 1, "time": 1}],
        user_info=[{"phone": str(i), "name": "ann"} for i in range(3)],
        factory_users=[{"phone": "p", "factory": "F"}, {"phone": "p", "factory": "G"}],
    )
    report = operations.purchases(t)
    assert report.rows().count() == report.total().first()["total"] == 6
    assert column(report.page(1, 4), "rn") == [1, 2, 3, 4]
    assert column(report.page(2, 4), "rn") == [5, 6]


def test_ids_of_money_events_may_coincide(spark):
    t = HandTables(
        spark,
        finance_logs=[{"log_key": 1, "use_id": 7, "count": -5, "time": 1}, {"log_key": 2, "use_id": 8, "count": None, "time": 0}],
        finance_output=[{"id": 7, "time": 3, "creator_id": "a"}],
        orders=[{"id": 7, "deliver_time": 3, "creator": "a"}],
        purchase=[{"id": 7, "buy_time": 4, "creator": "a"}],
    )
    rows = operations.finance_flow(t).page().collect()
    assert [(r["create_time"], r["sales"], r["input_output"]) for r in rows] == [
        (3, Decimal("5.00"), "支出"), (4, Decimal("5.00"), "支出"), (None, None, None),
    ]


def test_stock_branches_follow_each_other_whatever_their_times(spark):
    move = {"creator_id": "p", "factory": "F"}
    t = HandTables(
        spark,
        material_incoming=[{"id": 1, "time": 1, "materials": ["5", "6"], "counts": ["10"], **move}],
        material_outgoing=[{"id": 2, "time": 50, "materials": ["5"], "counts": None, **move}],
        product_incoming=[{"id": 3, "time": None, "products": ["5"], "counts": ["3", "4"], **move}],
        product_outgoing=[{"id": 5, "time": 7, **move}, {"id": 4, "time": 99, "products": [], "counts": ["1"], **move}],
        materials_log=[{"use_id": 1, "time": 11}, {"use_id": 1, "time": 12}, {"use_id": 3, "time": 1}],
        material_types=[{"id": 5, "name": "steel"}], products=[{"id": 5, "name": None}],
    )
    ledger = operations.stock_ledger(t)
    rows = ledger.page(1, 10).collect()
    assert [(r["id"], r["rn"], r["time"]) for r in rows] == [(1, 1, 11), (1, 2, 12), (2, 3, 0), (3, 4, 0), (4, 5, 0), (5, 6, 0)]
    assert [r["pairs"] is None for r in rows] == [False, False, True, False, True, True]
    items = operations.stock_items(t, ledger.page(1, 10), few=True).orderBy("rn", "pos").collect()
    assert [(r["rn"], r["name"], r["number"]) for r in items] == [(1, "steel", "10"), (2, "steel", "10"), (4, "", "3")]
    assert ledger.total().first()["total"] == 6


def test_ids_are_the_same_on_every_run(spark):
    df = requests(spark, "req_id bigint", [(1,), (2,)])
    made = df.select(values.short_id("job", F.col("req_id")).alias("a"), values.number_id("job", F.col("req_id")).alias("n"))
    first, again = made.collect(), made.collect()
    assert first == again and len({r["a"] for r in first}) == 2
    assert all(len(r["a"]) == 18 for r in first) and all(0 < r["n"] < 2**60 for r in first)


@pytest.mark.parametrize(
    ("payload", "content"),
    [
        ("data:image/png;base64,aGVsbG8=", b"hello"), ("a,b,aGVsbG8=", b"hello"), ("aGVsbG8=", None), (",", None), (None, None),
        (",aGVs\nbG8=", b"hello"), (",aGVsbG8", None), (",aGVsbG8h", b"hello!"), (",aGVsbG8=trailing", b"hello"), (",YQ==", b"a"),
        (",YQ=", None), (",YWE=====", b"aa"), (",!!!!", None),
    ],
)
def test_payloads(spark, payload, content):
    df = spark.createDataFrame([(payload,)], "p string")
    got = df.select(values.payload_bytes(F.col("p")).alias("b")).first()["b"]
    assert (None if got is None else bytes(got)) == content
