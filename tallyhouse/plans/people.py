"""Reports about users: identity reviews, user list, activity figures, coins, feedback, invitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.constants import (
    COMPANY_REWARD_WINDOW,
    FRIEND_REWARD_WINDOW,
    IMAGE_BASE,
    REWARD_START,
    TIME_ZONE,
)
from tallyhouse.functions.arrays import array_text
from tallyhouse.functions.days import DAY, daily_counts, day_start, within
from tallyhouse.functions.predicates import all_of, closed_range, contains, equals, keep
from tallyhouse.functions.values import blank, image_url, image_urls, percent, zero_as_null
from tallyhouse.operators.listing import ListReport, Lookup
from tallyhouse.operators.paging import newest_first
from tallyhouse.plans.lookups import Tables, company, membership, picked, searched, user

REVIEW_STATES = ("1", "2", "3")


def identity_reviews(
    t: Tables, id: str = "", username: str = "", name: str = "", country: str = "",
    start: int | None = None, endt: int | None = None, state: str | None = None, image_base: str = IMAGE_BASE,
) -> ListReport:
    """Identity papers with the review state of their user."""
    if state and state not in REVIEW_STATES:
        raise ValueError("state must be 1, 2 or 3")
    c = F.col
    papers = searched(t, "user_auth", phone=id, name=name)
    base = keep(
        papers,
        contains(c("phone"), id, always=True),
        contains(c("name"), name, always=True),
        within(papers, "time", start, endt),
        equals(c("country"), country),
    )
    return ListReport(
        base=base,
        lookups=[user(t, "phone")],
        tests=[
            ("user_name", contains(c("user_name"), username)),
            ("user_auth_state", equals(c("user_auth_state"), int(state) if state else None)),
        ],
        order=newest_first("time", "phone"),
        output=[
            blank(c("phone")).alias("id"),
            blank(c("user_name")).alias("username"),
            blank(c("type")).alias("type"),
            blank(c("name")).alias("name"),
            blank(c("country")).alias("country"),
            zero_as_null(c("time")).alias("time"),
            *[image_url(c(i), image_base).alias(i) for i in ("image1", "image2", "image3")],
            zero_as_null(c("user_auth_state")).alias("state"),
        ],
    )


def identity_review_page(t: Tables, page: int = 1, row: int = 10, **filters) -> DataFrame:
    """This page is never shorter than ten rows."""
    return identity_reviews(t, **filters).page(page, max(row, 10))


def users(
    t: Tables, id: str = "", name: str = "", factory_id: str | None = None, stime: int = 0,
    etime: int | None = None, sdsd: float | None = None, edsd: float | None = None, image_base: str = IMAGE_BASE,
) -> ListReport:
    """Users with their balance and companies; one row per membership."""
    c = F.col
    found = searched(t, "user_info", phone=id, name=name)
    base = keep(
        found,
        contains(c("phone"), id, always=True),
        contains(c("name"), name, always=True),
        within(found, "time", stime, etime),
        closed_range(c("coin"), sdsd, edsd),
    )
    return ListReport(
        base=base,
        lookups=[membership(t, "phone"), company(t, "member_factory")],
        tests=[("company_id", equals(c("company_id"), factory_id))],
        base_order=newest_first("time", "phone"),
        order=newest_first("time", "phone", "member_factory"),
        output=[
            c("phone"), c("name"),
            image_url(c("image"), image_base).alias("image"),
            c("coin").alias("dsd_val"),
            c("auth_state").alias("state"),
            c("time"),
            blank(c("company_title")).alias("factory"),
        ],
    )


def user_figures(t: Tables, as_of: int, tz: str = TIME_ZONE) -> DataFrame:
    """Total and new users, activity of the last seven days, and their ratio."""
    c = F.col
    is_new = c("time") > day_start(as_of, 0, tz)
    people = t["user_info"].agg(
        F.count("phone").alias("total_users"), F.count(F.when(is_new, c("phone"))).alias("new_users")
    )
    since = day_start(as_of, 6, tz)
    log = t["user_activity_log"]
    log = log.where((c("time") > since) & within(log, "time", since, None, tz)).agg(F.count("phone").alias("active_users"))
    # One pass over each table, the two single rows laid over each other.
    figures = people.unionByName(log, allowMissingColumns=True)
    names = ("total_users", "new_users", "active_users")
    return figures.agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names]).select(
        *names, percent(c("active_users"), c("total_users")).alias("active_rate")
    )


def new_users_daily(t: Tables, as_of: int, tz: str = TIME_ZONE) -> DataFrame:
    counts = daily_counts(t["user_info"], "time", "phone", day_start(as_of, 9, tz), as_of, 10, tz)
    return counts.orderBy("pos").select("date", "num")


def active_users_daily(t: Tables, as_of: int, tz: str = TIME_ZONE) -> DataFrame:
    """The window starts ten times 24 hours ago, not at midnight."""
    counts = daily_counts(t["user_activity_log"], "time", "phone", as_of - 10 * DAY, as_of, 10, tz)
    return counts.orderBy("pos").select("date", "num")


def city_series(spark: SparkSession) -> DataFrame:
    """Users by city have no source yet: an empty series."""
    return spark.createDataFrame([], "city string, num bigint")


def coin_ledger(
    t: Tables, id: str = "", name: str = "", type: str | None = None, factory_id: str | None = None,
    sdsd: float | None = None, edsd: float | None = None, image_base: str = IMAGE_BASE,
) -> ListReport:
    """Coin movements; phone and name are the user's, so they are NULL for unknown users."""
    c = F.col
    base = _coin_records(t, id, type, sdsd, edsd)
    return ListReport(
        base=base,
        lookups=[user(t, "user_id"), membership(t, "user_phone"), company(t, "member_factory")],
        tests=[
            ("user_name", contains(c("user_name"), name)), ("company_id", equals(c("company_id"), factory_id)),
        ],
        base_order=newest_first("time", "id"),
        order=newest_first("time", "id", "member_factory"),
        output=[
            c("user_phone").alias("phone"),
            c("user_name").alias("name"),
            image_url(c("user_image"), image_base).alias("image"),
            c("val").alias("dsd_val"),
            c("from_type").alias("type"),
            c("time"),
            blank(c("company_name")).alias("factory"),
        ],
    )


def _coin_records(t: Tables, id: str, type: str | None, sdsd: float | None, edsd: float | None) -> DataFrame:
    return keep(
        t["coin_records"],
        contains(F.col("user_id"), id, always=True),
        equals(F.col("from_type"), type),
        closed_range(F.col("val"), sdsd, edsd),
    )


def coin_ledger_shown_total(
    t: Tables, id: str = "", name: str = "", type: str | None = None, factory_id: str | None = None,
    sdsd: float | None = None, edsd: float | None = None,
) -> DataFrame:
    """The total shown beside the ledger: memberships joined straight on the ledger's user id and the *member* name
    tested, so it can differ from the ledger's own size."""
    c = F.col
    members = picked(t["factory_users"], "member_", "phone", "name", "factory")
    return ListReport(
        base=_coin_records(t, id, type, sdsd, edsd),
        lookups=[Lookup(members, "user_id", "member_phone"), company(t, "member_factory")],
        tests=[
            ("member_name", contains(c("member_name"), name)), ("company_id", equals(c("company_id"), factory_id)),
        ],
        order=newest_first("time", "id"),
        output=[],
    ).total()


def feedback(
    t: Tables, id: str = "", name: str = "", stime: int = 0, etime: int | None = None, image_base: str = IMAGE_BASE
) -> ListReport:
    c = F.col
    base = keep(
        t["user_feedback"], contains(c("phone"), id, always=True), within(t["user_feedback"], "time", stime, etime)
    )
    return ListReport(
        base=base,
        lookups=[user(t, "phone")],
        tests=[("user_name", contains(c("user_name"), name))],
        order=newest_first("time", "id"),
        output=[
            c("id"), c("phone"),
            c("user_name").alias("name"),
            image_url(c("user_image"), image_base).alias("image"),
            c("content"), c("resp"), c("time"), c("model"), c("system"), c("operator"),
            image_urls(c("images"), image_base).alias("images"),
        ],
    )


def _rewarded(*wins: tuple[Column, str]) -> Column:
    """'0' when some rule gives the reward, else '1'; a rule that meets a NULL does not."""
    reward = F.lit("1")
    for condition, code in reversed(wins):
        reward = F.when(condition, code).otherwise(reward)
    return reward


def invited_companies(t: Tables, invite_phone: str = "", admin_phone: str = "") -> ListReport:
    """Company applications whose applicant was invited by somebody."""
    c = F.col
    applicant = user(t, "id", "applicant_")
    admins = array_text(c("company_administrators"))
    invited = all_of(
        c("applicant_invitor_id").isNotNull(),
        contains(c("applicant_invitor_id"), invite_phone),
    )
    # The applicant is required, so it belongs to the base; cutting users to the invited ones comes first.
    base = t["bg_examine"].join(applicant.right.where(invited), c("id") == c("applicant_phone"))
    return ListReport(
        base=base,
        lookups=[
            user(t, "applicant_invitor_id", "inviter_"), membership(t, "id"), company(t, "member_factory"),
        ],
        tests=[("company_administrators", contains(admins, admin_phone))],
        base_order=newest_first("applicant_time", "id", "time"),
        order=newest_first("applicant_time", "id", "time", "member_factory"),
        output=[
            c("applicant_invitor_id").alias("invite_phone"),
            c("name").alias("factory"),
            F.coalesce("company_administrators", F.array().cast("array<string>")).alias("admin_phone"),
            c("applicant_time").alias("time"),
            blank(c("inviter_name")).alias("invite_name"),
            _rewarded(
                (c("applicant_time") <= REWARD_START, "0"),
                ((c("time") - c("applicant_time") <= COMPANY_REWARD_WINDOW) & (c("state") == "3"), "0"),
            ).alias("reward"),
        ],
    )


def invited_friends(t: Tables, invite_phone: str = "", invited_phone: str = "") -> ListReport:
    c = F.col
    base = keep(
        t["user_info"],
        c("invitor_id").isNotNull(),
        contains(c("phone"), invited_phone),
        contains(c("invitor_id"), invite_phone),
    )
    papers = t["user_auth"].select(c("phone").alias("auth_phone"), c("time").alias("verify_time"))
    return ListReport(
        base=base,
        lookups=[user(t, "invitor_id", "inviter_"), Lookup(papers, "phone", "auth_phone")],
        base_order=newest_first("time", "phone"),
        order=newest_first("time", "phone", "verify_time"),
        output=[
            c("phone").alias("invited_phone"),
            blank(c("name")).alias("invited_name"),
            blank(c("invitor_id")).alias("invite_phone"),
            c("time").alias("invite_time"),
            blank(c("inviter_name")).alias("invite_name"),
            c("verify_time"),
            _rewarded(
                (c("time") <= REWARD_START, "0"),
                (F.coalesce("verify_time", F.lit(0)) == 0, "1"),
                ((c("verify_time") - c("time") <= FRIEND_REWARD_WINDOW) & (c("auth_state") == 3), "0"),
            ).alias("reward"),
        ],
    )
