"""Reports about companies, their admins, applications and back-office accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.constants import EDITABLE_RIGHTS, IMAGE_BASE, PLAIN_ADMIN, SUPER_ADMIN
from tallyhouse.functions.arrays import array_text, capability_labels, right_labels
from tallyhouse.functions.days import within
from tallyhouse.functions.predicates import contains, keep
from tallyhouse.functions.values import blank, image_url
from tallyhouse.operators.listing import ListReport, Lookup
from tallyhouse.operators.paging import first_page_rows, newest_first, number_rows, page_bounds
from tallyhouse.plans.lookups import Tables, company, picked, searched, user


def company_names(t: Tables) -> DataFrame:
    """Every company, newest first."""
    return (
        t["factorys"].orderBy(*newest_first("time", "id").columns()).select(blank(F.col("id")).alias("id"), blank(F.col("name")).alias("name"))
    )


def company_applications(
    t: Tables, id: str = "", username: str = "", name: str = "", stime: int = 0, etime: int | None = None,
    image_base: str = IMAGE_BASE,
) -> ListReport:
    """Applications whose applicant is a known, named user."""
    c = F.col
    applicants = keep(
        t["user_info"], contains(c("name"), username, always=True), contains(c("phone"), id, always=True)
    ).select(c("phone").alias("applicant_phone"))
    asked = keep(t["bg_examine"], contains(c("name"), name, always=True), within(t["bg_examine"], "time", stime, etime))
    return ListReport(
        base=asked.join(applicants, c("id") == c("applicant_phone"), "left_semi"),
        lookups=[user(t, "id")],
        # Applications of one user that tie in all shown columns are the same row.
        order=newest_first(
            "time", "id", "name", "industry", "region", "contact", "image1", "image2", "state", "state_msg"
        ),
        output=[
            c("id"), c("name"), c("industry"), c("region"), c("contact"),
            image_url(c("image1"), image_base).alias("image1"),
            image_url(c("image2"), image_base).alias("image2"),
            c("state"), c("state_msg"), c("time"),
            c("user_name").alias("username"),
            image_url(c("user_image"), image_base).alias("user_image"),
        ],
    )


def admin_accounts(t: Tables, phone: str = "", username: str = "", name: str = "") -> ListReport:
    """Ordinary back-office accounts."""
    c = F.col
    base = keep(
        t["bg_user"], contains(c("phone"), phone), contains(c("username"), username), contains(c("name"), name),
        c("rights") == "1",
    )
    return ListReport(
        base=base, order=newest_first("time", "phone", "username"), output=[c("phone"), c("username"), c("name")]
    )


def _plain_members(members: DataFrame) -> DataFrame:
    """Members per company that are not its super admin; NULL rights count as neither."""
    plain = members.where(F.col("rights") != F.array(F.lit("1")))
    return plain.groupBy(F.col("factory").alias("plain_factory")).agg(F.count("phone").alias("plain_count"))


def companies(
    t: Tables, company_name: str = "", administrators: str = "", image_base: str = IMAGE_BASE
) -> ListReport:
    """Companies with the application of their only administrator and the number of ordinary admins."""
    c = F.col
    base = keep(
        searched(t, "factorys", title=company_name).withColumn("admin_text", array_text(c("administrators"))),
        contains(c("title"), company_name),
        contains(c("admin_text"), administrators),
    )
    application = picked(t["bg_examine"], "app_", "id", "industry", "region", "image1", "image2")
    members = t["factory_users"].select("phone", "rights", "factory")
    return ListReport(
        base=base,
        lookups=[
            # A company with several administrators has a text no single application id equals.
            Lookup(application, "admin_text", "app_id"),
            Lookup(
                _plain_members(members), "id", "plain_factory", unique=True,
                build=_plain_members, source=members, source_on="factory",
            ),
        ],
        base_order=newest_first("time", "id"),
        # Applications that tie in all of these show the same row.
        order=newest_first("time", "id", "app_image1", "app_image2", "app_industry", "app_region"),
        output=[
            c("id").alias("factory_id"),
            blank(c("name")).alias("contact"),
            blank(c("title")).alias("company_name"),
            F.coalesce("administrators", F.array().cast("array<string>")).alias("administrators"),
            blank(c("app_industry")).alias("company_category"),
            blank(c("app_region")).alias("company_area"),
            image_url(c("app_image1"), image_base).alias("auth_file"),
            image_url(c("app_image2"), image_base).alias("business_licence"),
            F.coalesce("plain_count", F.lit(0)).cast("bigint").alias("normal_admin"),
        ],
    )


class CompanyAdmins:
    """Ordinary admins of one company.

    Rows are numbered *before* the name filter and pages start after that number, so a filtered page skips numbers and
    reaches past ``offset + row``. Only then is the whole company numbered, in ranges; otherwise a page is a top-k.
    """

    def __init__(
        self, t: Tables, factory_id: str, username: str = "", phone: str = "", image_base: str = IMAGE_BASE
    ) -> None:
        if not factory_id:
            raise ValueError("factory_id is required")
        c = F.col
        members = keep(
            t["factory_users"].select("phone", "rights", c("time").alias("row_time"), "factory"),
            c("factory") == F.lit(factory_id),
            c("rights") != F.array(F.lit("1")),
            contains(c("phone"), phone),
        )
        # The same person may hold two equal-aged memberships; the rights text keeps those apart.
        members = members.withColumn("rights_text", array_text(c("rights")))
        self._named = contains(c("user_name"), username)
        self._list = ListReport(
            base=members,
            lookups=[company(t, "factory"), user(t, "phone")],
            order=newest_first("row_time", "phone", "rights_text"),
            output=[
                blank(c("phone")).alias("phone"),
                right_labels(c("rights")).alias("permission"),
                blank(c("factory")).alias("factory_id"),
                blank(c("company_title")).alias("company"),
                F.when(
                    F.coalesce(F.array_contains(c("company_administrators"), c("phone")), F.lit(False)), SUPER_ADMIN
                ).otherwise(PLAIN_ADMIN).alias("role"),
                blank(c("user_name")).alias("username"),
                image_url(c("user_image"), image_base).alias("avatar"),
            ],
        )

    def _filtered(self) -> ListReport:
        lst = self._list
        return ListReport(lst.base, lst.order, lst.output, lst.lookups, [("user_name", self._named)])

    def rows(self) -> DataFrame:
        return self._filtered().rows()

    def total(self) -> DataFrame:
        return self._filtered().total()

    def page(self, page: int = 1, row: int = 10) -> DataFrame:
        if self._named is None:
            return self._list.page(page, row)
        after, _ = page_bounds(page, row)
        lst = self._list
        numbered = number_rows(lst.base, lst.order.columns())
        for lookup in lst.lookups:
            numbered = lookup.attach(numbered)
        wanted = numbered.where(self._named & (F.col("rn") > after))
        return first_page_rows(wanted, [F.col("rn")], row).select(*lst.output, "rn").orderBy("rn")


def company_admins(t: Tables, factory_id: str, **filters) -> CompanyAdmins:
    return CompanyAdmins(t, factory_id, **filters)


def permission_catalogue(spark: SparkSession) -> DataFrame:
    """The rights a company admin may be given, shown beside the admin list."""
    return spark.createDataFrame(list(EDITABLE_RIGHTS.items()), "key string, value string")


def industry_applications(t: Tables, phone: str = "", name: str = "") -> ListReport:
    c = F.col
    base = keep(
        t["industry_plus_factorys"], contains(c("contact_phone"), phone), contains(c("company_name"), name)
    )
    return ListReport(
        base=base,
        order=newest_first("time", "phone", "company_name"),
        output=[
            c("phone"),
            blank(c("company_name")).alias("factory"),
            *[blank(c(n)).alias(n) for n in ("industry", "region", "contact_name", "contact_phone", "problems")],
            F.coalesce("supplement", F.array().cast("array<string>")).alias("supplement"),
            c("time"),
        ],
    )


def industry_tests(t: Tables, phone: str = "", name: str = "") -> ListReport:
    """Self-assessments with all five capabilities marked."""
    c = F.col
    base = keep(t["industry_plus_test"], contains(c("phone"), phone), contains(c("company_name"), name))
    return ListReport(
        base=base,
        order=newest_first("time", "phone", "company_name"),
        output=[
            c("phone"),
            blank(c("company_name")).alias("factory"),
            capability_labels(c("intelligent_degree")).alias("intelligent_degree"),
            c("score"), c("time"),
        ],
    )
