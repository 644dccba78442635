"""Jobs on companies, their admins and back-office accounts.

Requests of one batch take effect in (req_time, req_id) order. Where a request depends on earlier ones the dependence
is worked out from per-key first and last positions, or by ``settle``; no job walks through requests one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.arrays import distinct_list
from tallyhouse.functions.predicates import given, given_list, is_phone
from tallyhouse.functions.values import blank, short_id, uploaded_id, uploads
from tallyhouse.operators.changes import (
    accepted,
    append,
    count_matches,
    cut_to,
    delete,
    earliest,
    judged,
    latest,
    rejected,
    update,
)
from tallyhouse.operators.scratch import written
from tallyhouse.operators.settle import settle
from tallyhouse.plans.jobs import JobResult, request_order
from tallyhouse.plans.lookups import Tables


def _super_accounts(t: Tables) -> DataFrame:
    return t["bg_user"].where(F.col("rights") == "0")


def add_admin_accounts(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, actor, phone, name, req_time). The actor signs in by phone when it is 11 digits, else by user name."""
    c = F.col
    used = count_matches(requests, "phone", t["bg_user"], "phone", "_used")
    # Eleven digits are taken for a phone, whatever they start with.
    by_phone = c("actor").rlike(r"^\d{11}$")
    actors = used.withColumn("_as_phone", F.when(by_phone, c("actor"))).withColumn(
        "_as_name", F.when(~by_phone, c("actor"))
    )
    supers = _super_accounts(t)
    ranked = count_matches(
        count_matches(actors, "_as_phone", supers, "phone", "_by_phone"), "_as_name", supers, "username", "_by_name"
    )
    allowed = (c("_by_phone") + c("_by_name")) > 0
    able = is_phone(c("phone")) & (c("_used") == 0) & allowed
    first = earliest(ranked.where(able), ["phone"], request_order()).withColumnRenamed("phone", "_first_phone")
    checked = written(
        judged(
            ranked.join(first, ranked["phone"] == first["_first_phone"], "left"),
            ("bad phone", ~is_phone(c("phone"))),
            ("phone in use", (c("_used") > 0) | F.coalesce(c("_first") < request_order(), F.lit(False))),
            ("not allowed", ~allowed),
        )
    )
    ok = accepted(checked)
    rows = ok.select(
        F.substring(short_id("add_admin_accounts", c("req_id")), 1, 11).alias("username"), "phone",
        blank(c("name")).alias("name"), F.lit("1").alias("rights"), c("req_time").alias("time"),
    )
    return JobResult(
        "add_admin_accounts", requests, ok.select(*requests.columns), rejected(checked), appended={"bg_user": rows}
    )


def delete_admin_accounts(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, actor, phone, req_time). How the actor is looked up depends on the *target*: a valid target phone means
    by phone, anything else by user name.

    A deleted super account cannot act any more, so deletions of super accounts decide later requests of those accounts.
    Accounts are deleted by phone: a super account without one acts by its name and stays. Of several super accounts of one
    name one without a phone acts, else the one with the smallest phone.
    """
    c = F.col
    supers = _super_accounts(t).select(c("phone").alias("super_phone"), c("username").alias("super_name"))
    by_phone = supers.where(c("super_phone").isNotNull()).select(
        F.lit(True).alias("_phone_key"), c("super_phone").alias("_key"), "super_phone"
    )
    lasting = F.max(c("super_phone").isNull())
    by_name = supers.where(c("super_name").isNotNull()).groupBy("super_name").agg(
        F.when(~lasting, F.min("super_phone")).alias("super_phone")
    )
    keyed = by_phone.unionByName(by_name.select(F.lit(False).alias("_phone_key"), c("super_name").alias("_key"), "super_phone"))
    asked = requests.withColumn("_by_phone", is_phone(c("phone")))
    found = asked.join(
        keyed, (asked["_by_phone"] == keyed["_phone_key"]) & (asked["actor"] == keyed["_key"]), "left"
    ).withColumn("_order", request_order())
    able = found.where(c("_key").isNotNull() & c("phone").isNotNull())

    # Only deletions of super accounts matter to others, and of equal ones only the first.
    first_of_pair = (
        able.join(by_phone.select(c("super_phone").alias("_target")), c("phone") == c("_target"), "left_semi")
        .groupBy(c("super_phone").alias("actor_phone"), c("phone").alias("target")).agg(F.min("_order").alias("_order"))
    )
    settled = settle(first_of_pair, "_order", blocks=["target"], blocked_by=["actor_phone"])
    gone = settled.where("accepted").groupBy(c("target").alias("_gone")).agg(F.min("_order").alias("_gone_at"))
    checked = written(
        judged(
            found.join(gone, found["super_phone"] == gone["_gone"], "left"),
            ("missing phone", c("phone").isNull()),
            ("not allowed", c("_key").isNull() | F.coalesce(c("_gone_at") < c("_order"), F.lit(False))),
        )
    )
    ok = accepted(checked)
    return JobResult(
        "delete_admin_accounts", requests, ok.select(*requests.columns), rejected(checked),
        replaced={"bg_user": delete(t["bg_user"], ok, {"phone": "phone"})},
    )


def rename_admin_accounts(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, phone, new_name, req_time): no checks, unknown phones change nothing."""
    c = F.col
    last = latest(requests.withColumn("new_name", blank(c("new_name"))), ["phone"], request_order(), "new_name")
    return JobResult(
        "rename_admin_accounts", requests, requests, rejected(judged(requests)),
        replaced={"bg_user": update(t["bg_user"], last, ["phone"], {"name": c("change.new_name")})},
    )


def _sole_admins(t: Tables) -> DataFrame:
    """Companies that have exactly one administrator, with that administrator."""
    return t["factorys"].where(F.size("administrators") == 1).select(
        F.col("id").alias("company_id"), F.col("administrators")[0].alias("sole_admin")
    )


def _optional_upload(column: str, job: str) -> Column:
    payload = F.col(column)
    return F.when(given(payload), uploaded_id(payload, f"{job}.{column}", F.col("req_id"))).otherwise("")


def add_companies(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, company_name, contact, administrators, company_area, company_category, auth_file, business_licence,
    req_time); the two files may be left out of the batch.

    Within a batch an accepted company takes its administrator and its title, so acceptance is first come, first served
    over two keys at once.
    """
    c = F.col
    asked = requests
    for name in ("auth_file", "business_licence"):
        if name not in asked.columns:
            asked = asked.withColumn(name, F.lit(""))
    known = count_matches(asked, "administrators", _sole_admins(t), "sole_admin", "_admin_of")
    known = count_matches(known, "administrators", t["factory_users"], "phone", "_member_of")
    known = count_matches(known, "company_name", t["factorys"], "title", "_titles")
    standing = written(
        judged(
            known.withColumn("_order", request_order()),
            ("missing parameter", ~(given(c("company_name")) & given(c("contact")) & given(c("administrators")))),
            ("bad phone", ~is_phone(c("administrators"))),
            ("phone belongs to a company", (c("_admin_of") > 0) | (c("_member_of") > 0)),
            ("company name in use", c("_titles") > 0),
        )
    )
    # Equal (administrator, title) pairs stand or fall with the first of them.
    pairs = (
        standing.where(c("reason").isNull())
        .groupBy("administrators", "company_name").agg(F.min("_order").alias("_order"))
        .select(
            "_order", F.concat(F.lit("a|"), "administrators").alias("by_admin"),
            F.concat(F.lit("t|"), "company_name").alias("by_title"),
        )
    )
    keys = ["by_admin", "by_title"]
    winners = settle(pairs, "_order", blocks=keys, blocked_by=keys).where("accepted").select(
        c("_order").alias("_won"), c("by_admin").alias("_won_admin")
    )
    # An administrator wins at most once, so this join never multiplies rows.
    won = standing.join(winners, F.concat(F.lit("a|"), "administrators") == winners["_won_admin"], "left")
    lost = F.when(c("_won") < c("_order"), "phone belongs to a company").when(
        c("_won").isNull() | (c("_won") > c("_order")), "company name in use"
    )
    checked = written(won.withColumn("reason", F.coalesce("reason", lost)))
    ok = accepted(checked).select(*asked.columns)
    made = ok.withColumn("company_id", short_id("add_companies", c("req_id")))
    return JobResult(
        "add_companies", requests, ok.select(*requests.columns), rejected(checked),
        appended={
            "factorys": made.select(
                c("company_id").alias("id"), c("contact").alias("name"), c("company_name").alias("title"),
                F.array("administrators").alias("administrators"), c("req_time").alias("time"),
            ),
            "factory_users": made.select(
                c("administrators").alias("phone"), F.array(F.lit("1")).alias("rights"),
                c("company_id").alias("factory"), c("req_time").alias("time"),
            ),
            "bg_examine": made.select(
                c("administrators").alias("id"), c("company_name").alias("name"),
                blank(c("company_category")).alias("industry"), blank(c("company_area")).alias("region"),
                c("administrators").alias("contact"),
                _optional_upload("auth_file", "add_companies").alias("image1"),
                _optional_upload("business_licence", "add_companies").alias("image2"),
                c("req_time").alias("time"),
            ),
        },
        uploads=uploads(made, one={x: f"add_companies.{x}" for x in ("auth_file", "business_licence")}),
    )


def delete_companies(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id): the company with its apps, app orders and members, and the applications of its administrators."""
    c = F.col
    order = F.struct(*[n for n in ("req_time", "req_id") if n in requests.columns])
    known = count_matches(requests, "id", t["factorys"], "id", "_rows")
    first = earliest(requests, ["id"], order).withColumnRenamed("id", "_first_id")
    checked = written(
        judged(
            known.join(first, known["id"] == first["_first_id"], "left"),
            ("missing id", ~given(c("id"))),
            ("unknown company", (c("_rows") == 0) | (c("_first") < order)),
        )
    )
    ok = accepted(checked)
    gone = cut_to(t["factorys"], "id", ok, "id")
    admins = gone.select(F.explode("administrators").alias("admin"))
    return JobResult(
        "delete_companies", requests, ok.select(*requests.columns), rejected(checked),
        replaced={
            "bg_examine": delete(t["bg_examine"], admins, {"id": "admin"}),
            "factorys": delete(t["factorys"], ok, {"id": "id"}),
            "user_tp_apps": delete(t["user_tp_apps"], ok, {"factory_id": "id"}),
            "tp_apps_order": delete(t["tp_apps_order"], ok, {"factory_id": "id"}),
            "factory_users": delete(t["factory_users"], ok, {"factory": "id"}),
        },
    )


def _user_names(t: Tables, requests: DataFrame, phone: str) -> DataFrame:
    """Requests with ``user_name`` of the user behind a phone, '' when there is none."""
    names = cut_to(t["user_info"].select(F.col("phone").alias("_user"), "name"), "_user", requests, phone)
    return (
        requests.join(names.withColumnRenamed("name", "_name"), requests[phone] == F.col("_user"), "left")
        .withColumn("user_name", blank(F.col("_name")))
        .drop("_user", "_name")
    )


def add_company_admins(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, factory_id, new_administrators, permission, req_time): refused when the phone has exactly one membership.

    So a phone without any gets one (its first request), a phone with one gets none, and a phone with several gets all.
    """
    c = F.col
    known = count_matches(requests, "new_administrators", t["factory_users"], "phone", "_member_of")
    valid = given(c("factory_id")) & given(c("new_administrators")) & given_list(c("permission")) & is_phone(
        c("new_administrators")
    )
    first = earliest(known.where(valid), ["new_administrators"], request_order()).withColumnRenamed(
        "new_administrators", "_first_phone"
    )
    checked = written(
        judged(
            known.join(first, known["new_administrators"] == first["_first_phone"], "left"),
            (
                "missing parameter",
                ~(given(c("factory_id")) & given(c("new_administrators")) & given_list(c("permission"))),
            ),
            ("bad phone", ~is_phone(c("new_administrators"))),
            ("phone in use", (c("_member_of") == 1) | ((c("_member_of") == 0) & (c("_first") < request_order()))),
        )
    )
    ok = accepted(checked)
    rows = _user_names(t, ok, "new_administrators").select(
        c("new_administrators").alias("phone"), c("user_name").alias("name"),
        distinct_list(c("permission")).alias("rights"), c("factory_id").alias("factory"), c("req_time").alias("time"),
    )
    return JobResult(
        "add_company_admins", requests, ok.select(*requests.columns), rejected(checked), appended={"factory_users": rows}
    )


def change_company_admins(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, factory_id, administrators, new_administrators, permission, req_time): the old membership goes, the new
    phone joins under the old phone's name.

    A membership written by one request survives unless a *later* request of the batch removes that phone from that
    company, which the last removal per (company, phone) tells.
    """
    c = F.col
    checked = written(
        judged(
            requests,
            (
                "missing parameter",
                ~(
                    given(c("factory_id")) & given(c("administrators")) & given(c("new_administrators"))
                    & given_list(c("permission"))
                ),
            ),
        )
    )
    ok = accepted(checked)
    removed = ok.groupBy(c("factory_id").alias("_gone_factory"), c("administrators").alias("_gone_phone")).agg(
        F.max(request_order()).alias("_gone_at")
    )
    made = _user_names(t, ok, "administrators")
    lasting = made.join(
        removed,
        (made["factory_id"] == removed["_gone_factory"]) & (made["new_administrators"] == removed["_gone_phone"]),
        "left",
    ).where(c("_gone_at").isNull() | (c("_gone_at") <= request_order()))
    rows = lasting.select(
        c("new_administrators").alias("phone"), c("user_name").alias("name"),
        distinct_list(c("permission")).alias("rights"), c("factory_id").alias("factory"), c("req_time").alias("time"),
    )
    kept = delete(t["factory_users"], ok, {"factory": "factory_id", "phone": "administrators"})
    return JobResult(
        "change_company_admins", requests, ok, rejected(checked), replaced={"factory_users": append(kept, rows)}
    )


def remove_company_admins(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, factory_id, administrators, req_time): must be a member; the first request per membership removes it."""
    c = F.col
    pair = ["factory_id", "administrators"]
    members = cut_to(
        t["factory_users"].select("factory", c("phone").alias("_phone")), "factory", requests, "factory_id"
    ).distinct()
    first = earliest(requests, pair, request_order()).select(
        c("factory_id").alias("_ff"), c("administrators").alias("_fp"), "_first"
    )
    seen = requests.join(
        members, (requests["factory_id"] == members["factory"]) & (requests["administrators"] == members["_phone"]), "left"
    ).join(first, (c("factory_id") == c("_ff")) & (c("administrators") == c("_fp")), "left")
    checked = written(
        judged(
            seen,
            ("missing parameter", ~(given(c("factory_id")) & given(c("administrators")))),
            ("not a member", c("_phone").isNull() | (c("_first") < request_order())),
        )
    )
    ok = accepted(checked)
    return JobResult(
        "remove_company_admins", requests, ok.select(*requests.columns), rejected(checked),
        replaced={
            "factory_users": delete(t["factory_users"], ok, {"factory": "factory_id", "phone": "administrators"})
        },
    )
