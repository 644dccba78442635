"""Registered queries for single operators that the reports and jobs are built from."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.checks import report_oracles as o
from tallyhouse.checks.job_queries import _J01, _J03, _J04, _J18, number_id, phone_ok, short_id
from tallyhouse.checks.report_queries import flat
from tallyhouse.checks.standins import StandIns, with_standins
from tallyhouse.functions import arrays, days, predicates, values
from tallyhouse.operators import changes
from tallyhouse.operators.paging import newest_first, number_rows, row_total
from tallyhouse.operators.scratch import checkpoint_dir
from tallyhouse.plans import company_changes, operations, people, review_jobs
from tallyhouse.plans.lookups import Tables
from tallyhouse.sources import sinks
from tallyhouse.sources.store import TableStore
from tallyhouse.streaming import messages
from tallyhouse.streaming.apply import apply_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[Tables], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return flat(query(StandIns(spark, folder)))

    QUERIES[name] = run
    ORACLES[name] = with_standins(sql)


c = F.col  # resolved when a query runs

# Sources and sinks: scan, named columns, append, update, delete, upsert, evolution.
register("s1_scan", lambda t: t["orders"], "select * from fx_orders")
register(
    "s2_named_rows", lambda t: t["tp_apps"].select(c("id").alias("key"), c("name").alias("value")),
    "select id as key, name as value from fx_tp_apps",
)
register(
    "s4_append",
    lambda t: changes.append(
        t["coin_records"], t["req_coin_grant"].select(c("req_id").alias("id"), c("dsd_val").alias("val"))
    ),
    """select id, user_id, val, from_type, time from fx_coin_records union all
        select req_id, null, dsd_val, null, null from fx_req_coin_grant""",
)
register(
    "s5_update",
    lambda t: changes.update(
        t["user_info"],
        t["coin_records"].groupBy(c("user_id").alias("phone")).agg(F.sum("val").alias("added")),
        ["phone"], {"coin": c("coin") + c("change.added")},
    ),
    """select u.* replace (cast(u.coin + coalesce(r.added, 0) as decimal(18, 2)) as coin) from fx_user_info u
        left join (select user_id, sum(val) as added from fx_coin_records group by user_id) r on u.phone = r.user_id""",
)
register(
    "s6_delete", lambda t: changes.delete(t["user_xd_image_tag"], t["user_auth"], {"phone": "phone"}),
    "select * from fx_user_xd_image_tag where phone not in (select phone from fx_user_auth)",
)


def _upsert(t: Tables) -> DataFrame:
    rows = t["req_app_new"].select(
        F.concat(F.lit("app"), (c("req_id") % 300).cast("string")).alias("id"), "name", "slogan", "dsd_val", "url", "icon",
        "descs", "images", F.lit("0").alias("state"), c("req_time").alias("time"),
    )
    return changes.upsert(t["tp_apps"], rows, "id", order=F.struct("time", "name")).select("id", "name", "state", "time")


register(
    "s7_upsert", _upsert,
    """with n as (select concat('app', cast(req_id % 300 as varchar)) as id, name, '0' as state, req_time as time from fx_req_app_new
            qualify row_number() over (partition by concat('app', cast(req_id % 300 as varchar)) order by req_time desc, name desc) = 1)
        select id, name, state, time from fx_tp_apps where id not in (select id from n) union all select * from n""",
)
register(
    "s10_evolve",
    lambda t: changes.evolve(
        t["old_accounts"],
        add={
            "phone": ("string", None), "name": ("string", None), "rights": ("string", F.lit("1")), "time": ("bigint", None),
            "uid": ("string", values.short_id("uid", c("username"))),
        },
        retype={"code": "string"},
        backfill=[(c("username") == "admin", "rights", F.lit("0"))],
    ),
    f"""select username, cast(code as varchar) as code, cast(null as varchar) as phone, cast(null as varchar) as name,
        case when username = 'admin' then '0' else '1' end as rights, cast(null as bigint) as time,
        {short_id('uid', 'username')} as uid from fx_old_accounts""",
)
register(
    "s10_duplicates", lambda t: changes.duplicate_keys(t["req_company_new"], "company_name"),
    """select company_name, count(*) as times from fx_req_company_new where company_name is not null
        group by company_name having count(*) > 1""",
)



def _folder(t: StandIns) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/tallyhouse/{uuid.uuid4().hex}"


def _page_sink(t: StandIns, part: str) -> DataFrame:
    folder = _folder(t)
    report = people.users(t)
    page, total = report.page(2, 50), report.total()
    sinks.write_page(page, total, folder)
    return t.spark.read.schema((page if part == "data" else total).schema).json(f"{folder}/{part}")


register("s3_page_data", lambda t: _page_sink(t, "data"), o.users().page_body(2, 50))
register(
    "s3_page_total", lambda t: _page_sink(t, "total"), f"select count(*) as total from {o.users().source}"
)


def _published(t: StandIns) -> DataFrame:
    folder = _folder(t)
    sinks.publish(review_jobs.review_image_tags(t, t["req_image_tag_review"]).messages, folder)
    return t.spark.read.text(folder)


register(
    "s8_published", _published,
    """select cast(json_object('resource', 'BgXDImagesTag', 'type', 'PUT', 'params',
        json_object('id', cast(id as varchar), 'res', res, 'err_reason', err_reason)) as varchar) as value
        from fx_req_image_tag_review where res in ('0', '1')""",
)


# Requests arriving in files, applied by a stream that ends when they are used up.
def _streamed(t: StandIns, table: str) -> DataFrame:
    folder = _folder(t)
    arriving = t["req_coin_grant"]
    for part in range(3):
        arriving.where(c("req_id") % 3 == part).write.mode("append").parquet(f"{folder}/arriving")
    store = TableStore(t.spark, f"{folder}/store")
    store.commit(store.snapshot(), replaced={name: t[name] for name in ("user_info", "coin_records")})
    stream = t.spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/arriving")
    apply_stream(store, stream, review_jobs.grant_coins, f"{folder}/checkpoint").awaitTermination()
    return store.snapshot()[table]


_GRANTED = f"""select * from fx_req_coin_grant where {phone_ok('phone')} and dsd_val > 0
    and phone in (select phone from fx_user_info)"""
register(
    "m3_stream_users", lambda t: _streamed(t, "user_info"),
    f"""select u.* replace (cast(u.coin + coalesce(g.s, 0) as decimal(18, 2)) as coin) from fx_user_info u
        left join (select phone, sum(dsd_val) as s from ({_GRANTED}) x group by phone) g on u.phone = g.phone""",
)
register(
    "m3_stream_ledger", lambda t: _streamed(t, "coin_records"),
    f"""select id, user_id, val, from_type, time from fx_coin_records union all
        select {number_id('grant_coins', 'req_id')}, phone, dsd_val, 'system', req_time from ({_GRANTED}) x""",
)

# Predicates.
register(
    "p1_contains", lambda t: predicates.keep(t["user_info"], predicates.contains(c("name"), "00")).select("phone"),
    "select phone from fx_user_info where name like '%00%'",
)
register(
    "p1_empty_always",
    lambda t: predicates.keep(t["user_info"], predicates.contains(c("name"), "", always=True)).select("phone"),
    "select phone from fx_user_info where name like '%%'",
)
register(
    "p1_wildcards",
    lambda t: predicates.keep(t["user_info"], predicates.contains(c("name"), r"C_s%\#\0\_?")).select("phone").unionByName(
        predicates.keep(t["user_info"], predicates.contains(c("name"), r"C_s%\#0%1")).select("phone")
    ),
    r"""select phone from fx_user_info where name like '%C_s%#0\_?%' escape '\' union all
        select phone from fx_user_info where name like '%C_s%#0%1%' escape '\'""",
)
register(
    "p2_p5_present_only",
    lambda t: predicates.keep(
        t["coin_records"], predicates.equals(c("from_type"), "view"), predicates.equals(c("user_id"), ""),
        predicates.closed_range(c("val"), None, Decimal("50")), predicates.closed_range(c("time"), 1705000000, None),
    ),
    "select * from fx_coin_records where from_type = 'view' and val <= 50 and time >= 1705000000",
)
register(
    "p7_array_not_equal", lambda t: t["factory_users"].where(c("rights") != F.array(F.lit("1"))).select("phone", "factory"),
    "select phone, factory from fx_factory_users where rights <> ['1']",
)
register(
    "p9_phone_format", lambda t: t["req_coin_grant"].select("req_id", predicates.is_phone(c("phone")).alias("ok")),
    f"select req_id, {phone_ok('phone')} as ok from fx_req_coin_grant",
)

# Joins not already shown on their own by a report.
register(
    "n5_computed_key",
    lambda t: t["factorys"].select(c("id").alias("factory"), arrays.array_text(c("administrators")).alias("admins")).join(
        t["bg_examine"].select("id", "industry"), c("admins") == c("id"), "left"
    ).select("factory", "admins", "industry"),
    f"""select f.id as factory, {o.text('f.administrators')} as admins, e.industry from fx_factorys f
        left join fx_bg_examine e on {o.text('f.administrators')} = e.id""",
)
register(
    "n10_existence", lambda t: changes.count_matches(
        t["req_coin_grant"], "phone", t["user_info"], "phone", "accounts"
    ).select("req_id", "accounts"),
    """select req_id, (select count(*) from fx_user_info u where u.phone = q.phone) as accounts from fx_req_coin_grant q""",
)

# Numbering, set operations, aggregation.
register(
    "k2_ordered", lambda t: t["xd_learn_task"].orderBy("id").select("id", "title"),
    "select id, title from fx_xd_learn_task",
)
register(
    "k4_orders",
    lambda t: number_rows(t["orders"].select("id", "time"), newest_first("time", "id").columns()),
    "select id, time, cast(row_number() over (order by time desc nulls first, id) as bigint) as rn from fx_orders",
)
register(
    "u1_union_distinct", operations.money_events,
    """select id, time, creator_id as creator from fx_finance_output union select id, deliver_time, creator from fx_orders
        union select id, buy_time, creator from fx_purchase""",
)
register(
    "a1_total", lambda t: row_total(t["coin_records"]), "select count(*) as total from fx_coin_records",
)
register(
    "a4_daily_count",
    lambda t: t["user_activity_log"].groupBy(days.day_text(c("time")).alias("date")).agg(F.count("phone").alias("num")),
    """select strftime(date '1970-01-01' + cast(floor((time + 28800) / 86400) as integer), '%Y-%m-%d') as date,
        count(phone) as num from fx_user_activity_log group by 1""",
)
register(
    "a6_order_sums",
    lambda t: t["order_products"].groupBy("order_id").agg(F.sum("sell_price").cast("decimal(28,2)").alias("sales")),
    "select order_id, cast(sum(sell_price) as decimal(28, 2)) as sales from fx_order_products group by order_id",
)
register(
    "a10_members_per_company",
    lambda t: t["factorys"].select("id").join(
        t["factory_users"].groupBy("factory").agg(F.count("phone").alias("n")), c("id") == c("factory"), "left"
    ).select("id", F.coalesce("n", F.lit(0)).alias("members")),
    """select f.id, (select count(phone) from fx_factory_users m where m.factory = f.id) as members from fx_factorys f""",
)

# Scalar functions.
register(
    "f5_image_links", lambda t: t["user_feedback"].select("id", values.image_urls(c("images"), "https://i.example/").alias("links")),
    """select id, array_to_string(list_transform(images, lambda i: case when i is null or i = '' then ''
        else concat('https://i.example/', i, '.jpg') end), ',') as links from fx_user_feedback""",
)
register(
    "f6_bytes_to_text", lambda t: t["user_info"].select("phone", values.as_text(F.encode("image", "UTF-8")).alias("image")),
    "select phone, decode(encode(image)) as image from fx_user_info",
)
register(
    "f7_half_even",
    lambda t: t["purchase"].select(
        "id", values.money(c("total_price") / F.lit(8).cast("decimal(2,0)")).cast("decimal(18,2)").alias("eighth")
    ),
    # Exact cents: a quotient and a remainder of eighths, the half going to the even cent.
    """select id, cast(cast(cents // 8 + case when cents % 8 > 4 or (cents % 8 = 4 and (cents // 8) % 2 = 1) then 1 else 0 end
        as decimal(18, 2)) * cast(0.01 as decimal(3, 2)) as decimal(18, 2)) as eighth
        from (select id, cast(total_price * 100 as bigint) as cents from fx_purchase) p""",
)
register(
    "f9_safe_division",
    lambda t: t["purchase"].select(
        "id", F.try_divide(c("total_price").cast("double"), c("material_count").cast("double")).alias("price")
    ),
    "select id, cast(total_price as double) / nullif(cast(material_count as double), 0) as price from fx_purchase",
)
register(
    "f10_zip_shortest",
    lambda t: t["material_incoming"].select(
        "id", F.posexplode(arrays.zip_shortest(c("materials"), c("counts"), "item", "number")).alias("pos", "pair")
    ).select("id", "pos", "pair.item", "pair.number"),
    """select id, cast(i - 1 as int) as pos, materials[i] as item, counts[i] as number from
        (select *, unnest(range(1, least(len(materials), len(counts)) + 1)) as i from fx_material_incoming
            where materials is not null and counts is not null) z""",
)
register(
    "f11_right_labels",
    lambda t: t["factory_users"].select("phone", "factory", arrays.right_labels(c("rights")).alias("labels")),
    f"""select phone, factory, array_to_string(list_filter(list_transform(rights, lambda r: {o._RIGHTS}), lambda x: x is not null), ',')
        as labels from fx_factory_users""",
)
register(
    "f13_distinct_list",
    lambda t: t["req_learn_task_new"].select("req_id", arrays.distinct_list(c("keywords")).alias("keywords")),
    """select req_id, array_to_string(list_sort(list_distinct(keywords)), ',') as keywords from fx_req_learn_task_new""",
)


# Messages: what the grant and review jobs send, read back and routed.
def _sent(t: Tables) -> DataFrame:
    grants = review_jobs.grant_coins(t, t["req_coin_grant"]).messages
    tags = review_jobs.review_image_tags(t, t["req_image_tag_review"]).messages
    noise = t["user_feedback"].select(c("content").alias("value"))
    return messages.parsed(grants.select("value").unionByName(tags.select("value")).unionByName(noise))


_SENT_GRANTS = f"""select phone as id, cast(dsd_val as double) as dsd_val from fx_req_coin_grant
    where {phone_ok('phone')} and dsd_val > 0 and phone in (select phone from fx_user_info)"""
register(
    "m2_grants", lambda t: messages.params_of(_sent(t), "BgDSDGrant"), f"select 'POST' as type, id, dsd_val from ({_SENT_GRANTS}) g",
)
register(
    "m2_tag_reviews", lambda t: messages.params_of(_sent(t), "BgXDImagesTag"),
    "select 'PUT' as type, cast(id as varchar) as id, res, err_reason from fx_req_image_tag_review where res in ('0', '1')",
)
register(
    "m2_rejects", lambda t: messages.rejects(_sent(t)), "select content as value from fx_user_feedback",
)


def _kind(job: Callable, batch: str, kind: str) -> Callable[[Tables], DataFrame]:
    """The messages of one job among texts that are none, read back."""
    def read(t: Tables) -> DataFrame:
        noise = t["user_feedback"].select(c("content").alias("value"))
        return messages.params_of(messages.parsed(job(t, t[batch]).messages.select("value").unionByName(noise)), kind)

    return read


register(
    "m2_auth", _kind(review_jobs.review_identity, "req_identity_review", "BgAuth"),
    f"with {_J01} select 'POST' as type, phone as id, state, note as msg from r where reason is null",
)
register(
    "m2_feedback", _kind(review_jobs.reply_feedback, "req_feedback_reply", "BgFeedbackResp"),
    f"""with {_J03} select 'POST' as type, cast(id as varchar) as id,
        replace(replace(replace(msg, '''', ''''''), '\\''', ''''), '\\"', '"') as msg from r where reason is null""",
)
register(
    "m2_examine", _kind(review_jobs.decide_applications, "req_application_decision", "BgExamine"),
    f"with {_J04} select 'POST' as type, id, cast(state as integer) as state, coalesce(state_msg, '') as state_msg from a",
)
register(
    "m2_company", _kind(company_changes.modify_companies, "req_company_modify", "BgFacsModify"),
    f"""with {_J18} select 'POST' as type, factory_id as id, contact as name, company_name as title, administrators
        from r where reason is null""",
)

# Nested lists of reports, in chunks.
register(
    "r09_documents",
    lambda t: _shown(
        sinks.documents(
            operations.order_lines(t, operations.order_sales(t).rows()), ["order_id"], operations.LINE_FIELDS,
            operations.LINE_FIELDS, chunk=3,
        ),
        "order_id", *operations.LINE_FIELDS,
    ),
    """select order_id, (n - 1) // 3 as chunk, string_agg(concat_ws(':', coalesce(product_name, '*'),
            coalesce(cast(product_count as varchar), '*'), coalesce(product_unit, '*')), ',' order by n) as items
        from (select *, row_number() over (partition by order_id
                order by product_name nulls first, product_count nulls first, product_unit nulls first) as n
            from (select l.order_id, p.name as product_name, l.product_count, p.unit as product_unit
                from fx_order_products l left join fx_products p on l.product_id = p.id
                where l.order_id in (select id from fx_orders)) x) y
        group by order_id, chunk""",
)
register(
    "r13_documents",
    lambda t: _shown(
        sinks.documents(
            operations.stock_items(t, operations.stock_ledger(t).rows()), ["id", "category", "inout"], ["name", "number"],
            ["pos", "name", "number"], chunk=2,
        ),
        "id", "category", "inout", "name", "number",
    ),
    f"""select id, category, "inout", (n - 1) // 2 as chunk, string_agg(concat_ws(':', coalesce(name, '*'),
            coalesce(cast(number as varchar), '*')), ',' order by n) as items
        from (select *, row_number() over (partition by id, category, "inout" order by pos, name, number) as n
            from ({o.stock_items()}) x) y
        group by id, category, "inout", chunk""",
)


def _shown(documents: DataFrame, *names: str) -> DataFrame:
    """Documents with their items as text; the last names are the fields of an item."""
    keys = [n for n in names if n in documents.columns]
    fields = [n for n in names if n not in keys]
    text = F.transform("items", lambda i: F.concat_ws(":", *[F.coalesce(i[f].cast("string"), F.lit("*")) for f in fields]))
    return documents.select(*keys, "chunk", F.array_join(text, ",").alias("items"))
