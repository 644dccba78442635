"""Registered report queries with their oracle text, pairwise."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.checks import report_oracles as o
from tallyhouse.checks.standins import StandIns, with_standins
from tallyhouse.functions.arrays import array_text
from tallyhouse.operators.listing import ListReport
from tallyhouse.plans import companies, operations, people
from tallyhouse.plans.lookups import Tables

Query = Callable[[SparkSession, str], DataFrame]
Report = Callable[[Tables], DataFrame]

# Moments at which the figures have data on both sides of every limit.
USERS_AS_OF = 1552867200
ACTIVITY_AS_OF = 1706616000

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Text lists as joined text, so that both engines compare plain values."""
    return df.select(
        *[
            array_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema
        ]
    )


def register(name: str, report: Report, oracle: str | None) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return flat(report(StandIns(spark, folder)))

    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def register_list(prefix: str, report: Callable[..., object], body: Callable[..., o.Body], *, every: bool = False) -> None:
    """Whole relation, first and third page, and total of an unfiltered list."""
    register(f"{prefix}_all", lambda t: report(t).rows(), body().all())
    register(f"{prefix}_page", lambda t: report(t).page(1, 10), body().page(1, 10))
    register(f"{prefix}_page3", lambda t: report(t).page(3, 7), body().page(3, 7))
    register(f"{prefix}_total", lambda t: report(t).total(), body().total())
    if every:
        register(f"{prefix}_numbered", lambda t: report(t).numbered(), body().every())


def register_filtered(prefix: str, report: Callable[[Tables], object], body: o.Body, page: int = 1, row: int = 10) -> None:
    register(f"{prefix}_all", lambda t: report(t).rows(), body.all())
    register(f"{prefix}_page", lambda t: report(t).page(page, row), body.page(page, row))
    register(f"{prefix}_total", lambda t: report(t).total(), body.total())


# R01
register_list("r01", people.identity_reviews, o.identity_reviews)
register(
    "r01_short_page", lambda t: people.identity_review_page(t, page=2, row=3), o.identity_reviews().page(2, 10)
)
register_filtered(
    "r01_filtered",
    lambda t: people.identity_reviews(
        t, id="138", name="Customer", country="C3", username="00", state="3", start=1550073600, endt=1560000000
    ),
    o.identity_reviews(
        "u.name like '%00%' and u.auth_state = 3",
        "phone like '%138%' and name like '%Customer%' and country = 'C3' and time between 1550073600 and 1560000000",
    ),
)
# R02
register(
    "r02_all", companies.company_names,
    with_standins("select coalesce(id, '') as id, coalesce(name, '') as name from fx_factorys"),
)
# R03
register_list("r03", people.users, o.users)
register_filtered("r03_company", lambda t: people.users(t, factory_id="F7"), o.users("f.id = 'F7'"))
register_filtered(
    "r03_filtered",
    lambda t: people.users(
        t, id="000", name="Customer", stime=1550100000, etime=1555000000, sdsd=Decimal("10.5"), edsd=Decimal("7000")
    ),
    o.users(
        base="phone like '%000%' and name like '%Customer%' and time between 1550100000 and 1555000000 "
        "and coin between 10.5 and 7000"
    ),
    page=2, row=5,
)

# R04
_DAY0 = "1552838400"  # 2019-03-18 00:00 Asia/Shanghai
_ACT_DAY0 = "1706544000"  # 2024-01-30 00:00 Asia/Shanghai


def _daily(table: str, after: str, day0: str) -> str:
    day = "strftime(date '1970-01-01' + cast(floor(({0} + 28800) / 86400) as integer), '%Y-%m-%d')"
    return with_standins(
        f"""select s.date, cast(coalesce(c.n, 0) as bigint) as num
            from (select {day.format(f'({day0} - i * 86400)')} as date from range(0, 10) r(i)) s
            left join (select {day.format('time')} as d, count(phone) as n from fx_{table} where time > {after} group by 1) c
            on c.d = s.date"""
    )


def _figures(as_of_day: int) -> str:
    return with_standins(
        f"""select total_users, new_users, active_users,
            cast(case when total_users > 0 then round_even(active_users * 100.0 / total_users, 2) else 0 end as decimal(18, 2))
            as active_rate from
            (select (select count(phone) from fx_user_info) as total_users,
                (select count(phone) from fx_user_info where time > {as_of_day}) as new_users,
                (select count(phone) from fx_user_activity_log where time > {as_of_day} - 6 * 86400) as active_users) f"""
    )


register("r04_figures", lambda t: people.user_figures(t, ACTIVITY_AS_OF), _figures(1706544000))
register("r04_figures_users", lambda t: people.user_figures(t, USERS_AS_OF), _figures(1552838400))
register(
    "r04_new_users_daily", lambda t: people.new_users_daily(t, USERS_AS_OF),
    _daily("user_info", f"{_DAY0} - 9 * 86400", _DAY0),
)
register(
    "r04_active_users_daily", lambda t: people.active_users_daily(t, ACTIVITY_AS_OF),
    _daily("user_activity_log", f"{ACTIVITY_AS_OF} - 10 * 86400", _ACT_DAY0),
)
# R05
register_list("r05", people.coin_ledger, o.coin_ledger)
register("r05_deep_page", lambda t: people.coin_ledger(t).page_by_rank(120, 75), o.coin_ledger().page(120, 75))
register("r05_total_ref", people.coin_ledger_shown_total, o.coin_ledger_shown_total())
register_filtered(
    "r05_filtered",
    lambda t: people.coin_ledger(
        t, id="1380", name="Customer", type="purchase", factory_id="F3", sdsd=Decimal("1"), edsd=Decimal("900")
    ),
    o.coin_ledger(
        "u.name like '%Customer%' and f.id = 'F3'",
        "user_id like '%1380%' and from_type = 'purchase' and val between 1 and 900",
    ),
)
register(
    "r05_filtered_total_ref", lambda t: people.coin_ledger_shown_total(t, name="9", factory_id="F3", type="click"),
    o.coin_ledger_shown_total("m.name like '%9%' and f.id = 'F3'", "from_type = 'click'"),
)
# R06
register_list("r06", people.feedback, o.feedback)
register_filtered(
    "r06_filtered",
    lambda t: people.feedback(t, id="38", name="Cust", stime=1704100000, etime=1706000000),
    o.feedback("u.name like '%Cust%'", "phone like '%38%' and time between 1704100000 and 1706000000"),
)
# R07
register_list("r07", companies.company_applications, o.company_applications)
register_filtered(
    "r07_filtered",
    lambda t: companies.company_applications(t, id="00", username="Customer", name="Company", stime=1, etime=1555000000),
    o.company_applications(
        "name like '%Customer%' and phone like '%00%'", "name like '%Company%' and time between 1 and 1555000000"
    ),
)
# R08
register_list("r08", operations.apps, o.apps)
register("r08_id_page", lambda t: operations.apps(t, id="app11").page(), o.apps("id = 'app11'").page())
register_filtered("r08_filtered", lambda t: operations.apps(t, name="a"), o.apps("name like '%a%'"))
# R09
register_list("r09", operations.order_sales, o.order_sales, every=True)
register_filtered(
    "r09_filtered",
    lambda t: operations.order_sales(t, id="1380", name="Customer", company_name="1"),
    o.order_sales("u.name like '%Customer%' and f.name like '%1%'", "creator like '%1380%'"),
)


def _page_lines(t: Tables) -> DataFrame:
    report = operations.order_sales(t)
    return operations.order_lines(t, report.page(1, 10))


_LINES = """select l.order_id, p.name as product_name, l.product_count, p.unit as product_unit
    from fx_order_products l left join fx_products p on l.product_id = p.id"""
register(
    "r09_lines", lambda t: operations.order_lines(t, operations.order_sales(t).rows()),
    with_standins(f"{_LINES} where l.order_id in (select id from fx_orders)"),
)
register(
    "r09_page_lines", _page_lines,
    with_standins(f"{_LINES} where l.order_id in (select id from fx_orders order by time desc nulls first, id limit 10)"),
)
# R10
register_list("r10", operations.finance_flow, o.finance_flow, every=True)
register("r10_deep_page", lambda t: operations.finance_flow(t).page_by_rank(15, 400), o.finance_flow().page(15, 400))
register_filtered(
    "r10_filtered", lambda t: operations.finance_flow(t, id="138", name="Customer", company_name="Supp"),
    o.finance_flow("u.phone like '%138%' and u.name like '%Customer%' and f.name like '%Supp%'"),
)
# R11
register_list("r11", operations.purchases, o.purchases)
register_filtered(
    "r11_filtered", lambda t: operations.purchases(t, id="1380000", name="Customer", company_name="Supp"),
    o.purchases("u.phone like '%1380000%' and p.buyer like '%Customer%' and f.name like '%Supp%'"),
)
# R12
register_list("r12", operations.production, o.production)
register_filtered(
    "r12_filtered", lambda t: operations.production(t, id="138", name="Customer", company_name="Company"),
    o.production("u.phone like '%138%' and u.name like '%Customer%' and f.title like '%Company%'"),
)
register("r12_total_ref", operations.production_shown_total, o.production().total())

# R13
_STOCK_SHOWN = ("category", "inout", "time", "recorder", "company", "create_time")
_STOCK_FILTER = "u.phone like '%138%' and u.name like '%Customer%' and f.title like '%1%'"


def _stock_filtered(t: Tables) -> ListReport:
    return operations.stock_ledger(t, id="138", name="Customer", company_name="1")


register("r13_all", lambda t: operations.stock_ledger(t).rows().select(*_STOCK_SHOWN), o.stock().all())
register(
    "r13_page", lambda t: operations.stock_ledger(t).page(1, 10).select(*_STOCK_SHOWN, "rn"), o.stock().page(1, 10)
)
register(
    "r13_page_across", lambda t: operations.stock_ledger(t).page(15, 273).select(*_STOCK_SHOWN, "rn"),
    o.stock().page(15, 273),
)
register(
    "r13_numbered", lambda t: operations.stock_ledger(t).numbered().select(*_STOCK_SHOWN, "rn"), o.stock().every()
)
register("r13_total", lambda t: operations.stock_ledger(t).total(), o.stock().total())
register("r13_total_ref", operations.stock_shown_total, o.stock().total())
register("r13_filtered_all", lambda t: _stock_filtered(t).rows().select(*_STOCK_SHOWN), o.stock(_STOCK_FILTER).all())
register(
    "r13_filtered_page", lambda t: _stock_filtered(t).page(2, 25).select(*_STOCK_SHOWN, "rn"),
    o.stock(_STOCK_FILTER).page(2, 25),
)
register("r13_filtered_total", lambda t: _stock_filtered(t).total(), o.stock(_STOCK_FILTER).total())
register(
    "r13_items",
    lambda t: operations.stock_items(t, operations.stock_ledger(t).rows()).select(
        "id", "category", "inout", "pos", "name", "number"
    ),
    o.stock_items(),
)
register(
    "r13_page_items",
    lambda t: operations.stock_items(t, operations.stock_ledger(t).page(2, 20), few=True).select(
        "rn", "category", "inout", "pos", "name", "number"
    ),
    o.stock_items(page=(2, 20)),
)
# R14, R15
register("r14_all", operations.learn_tasks, with_standins(o.LEARN_TASKS))
register(
    "r14_total", operations.learn_task_total,
    with_standins("select count(*) as total from fx_xd_learn_task"),
)
for _level in (1, 2):
    register(
        f"r15_level{_level}", lambda t, level=_level: operations.tag_keywords(t, level),
        with_standins(f"select id as key, keyword as value from fx_xd_image_keyword where level = {_level}"),
    )
# R16
register_list("r16", operations.image_tags, o.image_tags)
register_filtered(
    "r16_filtered", lambda t: operations.image_tags(t, phone="13", name="1", state="1", keyword=4),
    o.image_tags("u.name like '%1%' and g.phone like '%13%' and g.state = '1' and g.keyword_id = 4"),
)
# R17
register_list("r17", companies.admin_accounts, o.admin_accounts)
register_filtered(
    "r17_filtered", lambda t: companies.admin_accounts(t, phone="0", username="u", name="5"),
    o.admin_accounts("phone like '%0%' and username like '%u%' and name like '%5%'"),
)
# R18
register_list("r18", companies.companies, o.companies)
register_filtered(
    "r18_filtered", lambda t: companies.companies(t, company_name="Company", administrators="0001"),
    o.companies(f"title like '%Company%' and {o.text('administrators')} like '%0001%'"),
)
# R19
register("r19_page", lambda t: companies.company_admins(t, "F7").page(1, 5), o.company_admins_page("F7", 1, 5))
# Members of a company that has no row of its own.
register("r19_no_company_page", lambda t: companies.company_admins(t, "F105").page(1, 5), o.company_admins_page("F105", 1, 5))
register("r19_total", lambda t: companies.company_admins(t, "F7").total(), o.company_admins_total("F7"))
register(
    "r19_named_page", lambda t: companies.company_admins(t, "F7", username="12", phone="138").page(1, 3),
    o.company_admins_page("F7", 1, 3, "raw_name like '%12%'", "phone like '%138%'"),
)
register(
    "r19_named_page2", lambda t: companies.company_admins(t, "F8", username="1").page(2, 3),
    o.company_admins_page("F8", 2, 3, "raw_name like '%1%'"),
)
register(
    "r19_named_total", lambda t: companies.company_admins(t, "F7", username="12").total(),
    o.company_admins_total("F7", "raw_name like '%12%'"),
)
# R20, R21
register_list("r20", companies.industry_applications, o.industry_applications)
register_filtered(
    "r20_filtered", lambda t: companies.industry_applications(t, phone="00", name="8"),
    o.industry_applications("contact_phone like '%00%' and company_name like '%8%'"),
)
register_list("r21", companies.industry_tests, o.industry_tests)
register_filtered(
    "r21_filtered", lambda t: companies.industry_tests(t, phone="00", name="8"),
    o.industry_tests("phone like '%00%' and company_name like '%8%'"),
)
# R22, R23
register_list("r22", people.invited_companies, o.invited_companies)
register_filtered(
    "r22_filtered", lambda t: people.invited_companies(t, invite_phone="0001", admin_phone="1380"),
    o.invited_companies(f"a.invitor_id like '%0001%' and {o.text('f.administrators')} like '%1380%'"),
)
register_list("r23", people.invited_friends, o.invited_friends)
register_filtered(
    "r23_filtered", lambda t: people.invited_friends(t, invite_phone="0001", invited_phone="00"),
    o.invited_friends("u.phone like '%00%' and u.invitor_id like '%0001%'"),
)
# R24
register_list("r24", operations.banners, lambda: o.BANNERS)
