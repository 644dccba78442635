"""Jobs that review, grant and reply: identity papers, coins, feedback, applications, tagged images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.constants import REVIEW_FAILED, REVIEW_PASSED
from tallyhouse.functions.predicates import given, is_phone, one_of
from tallyhouse.functions.values import blank, message, number_id, short_id
from tallyhouse.operators.changes import (
    accepted,
    count_matches,
    cut_to,
    delete,
    judged,
    latest,
    rejected,
    update,
)
from tallyhouse.operators.scratch import written
from tallyhouse.plans.jobs import JobResult, request_order
from tallyhouse.plans.lookups import Tables


def review_identity(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, phone, state, msg, req_time): 2 fails, 3 passes, 0 only sends the message."""
    c = F.col
    known = count_matches(requests, "phone", t["user_info"], "phone", "_users")
    checked = written(
        judged(
            known,
            ("missing id", ~given(c("phone"))),
            ("bad state", ~one_of(c("state"), ("0", "2", "3"))),
            ("unknown user", c("_users") == 0),
        ).withColumn("note", F.when(given(c("msg")), c("msg")).otherwise(REVIEW_FAILED))
    )
    ok = accepted(checked)
    note = F.when(c("state") == "3", REVIEW_PASSED).otherwise(c("note"))
    effective = ok.where(c("state").isin("2", "3")).withColumn("auth_msg", note)
    last = latest(effective, ["phone"], request_order(), "state", "auth_msg")
    return JobResult(
        "review_identity", requests, ok.select(*requests.columns), rejected(checked),
        replaced={
            "user_info": update(t["user_info"], last, ["phone"], {"auth_state": c("change.state").cast("int")}),
            "user_auth": update(t["user_auth"], last, ["phone"], {"auth_msg": c("change.auth_msg")}),
        },
        messages=ok.select("req_id", message("BgAuth", "POST", id=c("phone"), state=c("state"), msg=c("note")).alias("value")),
    )


def grant_coins(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, phone, dsd_val, req_time): a ledger row and a higher balance for each valid grant."""
    c = F.col
    known = count_matches(requests, "phone", t["user_info"], "phone", "_users")
    checked = written(
        judged(
            known,
            ("bad phone", ~is_phone(c("phone"))),
            ("bad value", ~F.coalesce(c("dsd_val") > 0, F.lit(False))),
            ("unknown account", c("_users") != 1),
        )
    )
    ok = accepted(checked)
    # Summed per task before the shuffle: an account with any share of the grants is one row per task.
    sums = ok.groupBy("phone").agg(F.sum("dsd_val").alias("granted"))
    ledger = ok.select(
        number_id("grant_coins", c("req_id")).alias("id"), c("phone").alias("user_id"), c("dsd_val").alias("val"),
        F.lit("system").alias("from_type"), c("req_time").alias("time"),
    )
    return JobResult(
        "grant_coins", requests, ok.select(*requests.columns), rejected(checked),
        replaced={"user_info": update(t["user_info"], sums, ["phone"], {"coin": c("coin") + c("change.granted")})},
        appended={"coin_records": ledger},
        messages=ok.select(
            "req_id",
            message("BgDSDGrant", "POST", id=c("phone"), dsd_val=c("dsd_val").cast("double")).alias("value"),
        ),
    )


def reply_feedback(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, msg, req_time). The message carries the text with doubled quotes and bare escaped quotes."""
    c = F.col
    checked = written(
        judged(
            requests,
            ("missing id", ~given(c("id").cast("string"))),
            ("missing message", ~given(c("msg"))),
        )
    )
    ok = accepted(checked)
    last = latest(ok, ["id"], request_order(), "msg")
    doubled = F.replace(c("msg"), F.lit("'"), F.lit("''"))
    sent = F.replace(F.replace(doubled, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    return JobResult(
        "reply_feedback", requests, ok, rejected(checked),
        replaced={"user_feedback": update(t["user_feedback"], last, ["id"], {"resp": c("change.msg")})},
        messages=ok.select(
            "req_id", message("BgFeedbackResp", "POST", id=c("id").cast("string"), msg=sent).alias("value")
        ),
    )


def decide_applications(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, state int, state_msg, req_time). State 3 also founds a company, its super admin and a client row.

    Each approval founds its own company, also when the same application is approved twice.
    """
    c = F.col
    wanted = cut_to(t["bg_examine"].select("id", "name", "industry", "region", "contact"), "id", requests, "id")
    # Ids are not declared unique here; the smallest row stands for the application.
    forms = wanted.groupBy(c("id").alias("_form_id")).agg(
        F.min(F.struct("name", "industry", "region", "contact")).alias("form")
    )
    found = requests.join(forms, requests["id"] == forms["_form_id"], "left").drop("_form_id")
    checked = written(
        judged(
            found,
            ("missing id", ~given(c("id"))),
            ("missing state", c("state").isNull()),
            ("unknown application", (c("state") == 3) & c("form").isNull()),
        )
    )
    ok = accepted(checked)
    note = F.when(given(c("state_msg")), c("state_msg"))
    # ``max_by`` passes over rows whose ordering is NULL, so notes left out do not count.
    outcome = ok.groupBy("id").agg(
        F.max_by("state", request_order()).alias("state"),
        F.max_by(note, F.when(note.isNotNull(), request_order())).alias("note"),
    )
    approved = ok.where(c("state") == 3).withColumn("company_id", short_id("decide_applications", c("req_id")))
    contacts = cut_to(
        t["user_info"].select("phone", c("name").alias("contact_name")), "phone",
        approved.select(c("form.contact").alias("contact")), "contact",
    )
    clients = approved.join(contacts, approved["form"]["contact"] == contacts["phone"], "left")
    return JobResult(
        "decide_applications", requests, ok.select(*requests.columns), rejected(checked),
        replaced={
            "bg_examine": update(
                t["bg_examine"], outcome, ["id"],
                {
                    "state": c("change.state").cast("string"),
                    "state_msg": F.coalesce(c("change.note"), c("state_msg")),
                },
            )
        },
        appended={
            "factorys": approved.select(
                c("company_id").alias("id"), blank(c("form.name")).alias("name"),
                blank(c("form.name")).alias("title"), F.array("id").alias("administrators"), c("req_time").alias("time"),
            ),
            "factory_users": approved.select(
                c("id").alias("phone"), F.array(F.lit("1")).alias("rights"), c("company_id").alias("factory"),
                c("req_time").alias("time"),
            ),
            "base_clients_pool": clients.select(
                blank(c("form.name")).alias("name"), blank(c("contact_name")).alias("contacts"),
                blank(c("form.contact")).alias("phone"), blank(c("form.industry")).alias("industry"),
                c("req_time").alias("create_time"), blank(c("form.region")).alias("region"),
                F.lit("").alias("address"),
            ),
        },
        messages=approved.select(
            "req_id",
            message("BgExamine", "POST", id=c("id"), state=c("state"), state_msg=blank(c("state_msg"))).alias("value"),
        ),
    )


def review_image_tags(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, res, err_reason, req_time): '1' passes (state 2), '0' fails (state 1)."""
    c = F.col
    checked = written(
        judged(requests, ("missing id", c("id").isNull()), ("bad res", ~one_of(c("res"), ("0", "1"))))
    )
    ok = accepted(checked).withColumn("err_reason", blank(c("err_reason")))
    last = latest(ok, ["id"], request_order(), "res", "err_reason")
    return JobResult(
        "review_image_tags", requests, ok, rejected(checked),
        replaced={
            "user_xd_image_tag": update(
                t["user_xd_image_tag"], last, ["id"],
                {"state": F.when(c("change.res") == "1", "2").otherwise("1"), "err_reason": c("change.err_reason")},
            )
        },
        messages=ok.select(
            "req_id",
            message(
                "BgXDImagesTag", "PUT", id=c("id").cast("string"), res=c("res"), err_reason=c("err_reason")
            ).alias("value"),
        ),
    )


def delete_image_tags(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, req_time)."""
    checked = written(judged(requests, ("missing id", F.col("id").isNull())))
    ok = accepted(checked)
    return JobResult(
        "delete_image_tags", requests, ok, rejected(checked),
        replaced={"user_xd_image_tag": delete(t["user_xd_image_tag"], ok, {"id": "id"})},
    )
