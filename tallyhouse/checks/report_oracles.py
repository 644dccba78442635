"""Independent DuckDB text of the report queries, written from the report definitions, not from the Spark code.

A report is one ``body`` (every column it shows plus those it sorts by), a sort, and the list of shown columns; the
three questions asked of it (all rows, one page, the total) follow from that.
"""

from __future__ import annotations

from tallyhouse.checks.standins import with_standins
from tallyhouse.constants import (
    CAPABILITY_DONE,
    CAPABILITY_LABELS,
    CAPABILITY_MISSING,
    IMAGE_BASE,
    RIGHT_LABELS,
)


def url(x: str) -> str:
    return f"case when {x} is null or {x} = '' then '' else concat('{IMAGE_BASE}', {x}, '.jpg') end"


def urls_text(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda i: {url('i')}), ',')"


def text(x: str) -> str:
    """A text list as one string, NULL entries as '*'."""
    return f"array_to_string(list_transform({x}, lambda i: coalesce(i, '*')), ',')"


class Body:
    def __init__(self, columns: str, source: str, order: str) -> None:
        self.columns = columns
        self.source = source
        self.order = order

    def all(self) -> str:
        return with_standins(f"select {self.columns} from {self.source}")

    def numbered(self) -> str:
        return (
            f"select {self.columns}, cast(row_number() over (order by {self.order}) as bigint) as rn from {self.source}"
        )

    def every(self) -> str:
        return with_standins(self.numbered())

    def page_body(self, page: int = 1, row: int = 10) -> str:
        low, high = (page - 1) * row, page * row
        return f"select * from ({self.numbered()}) numbered where rn > {low} and rn <= {high}"

    def page(self, page: int = 1, row: int = 10) -> str:
        return with_standins(self.page_body(page, row))

    def total(self) -> str:
        return with_standins(f"select cast(count(*) as bigint) as total from {self.source}")


_URL3 = ", ".join(f"{url('a.' + i)} as {i}" for i in ("image1", "image2", "image3"))


def identity_reviews(where: str = "true", base: str = "true") -> Body:
    return Body(
        f"""coalesce(a.phone, '') as id, coalesce(u.name, '') as username, coalesce(a.type, '') as type,
            coalesce(a.name, '') as name, coalesce(a.country, '') as country, nullif(a.time, 0) as time, {_URL3},
            nullif(u.auth_state, 0) as state""",
        f"""(select * from fx_user_auth where phone is not null and name is not null and {base}) a
            left join fx_user_info u on a.phone = u.phone where {where}""",
        "a.time desc nulls first, a.phone",
    )


def users(where: str = "true", base: str = "true") -> Body:
    return Body(
        f"""u.phone, u.name, {url('u.image')} as image, u.coin as dsd_val, u.auth_state as state, u.time,
            coalesce(f.title, '') as factory""",
        f"""(select * from fx_user_info where phone is not null and name is not null and time >= 0 and {base}) u
            left join fx_factory_users m on u.phone = m.phone left join fx_factorys f on m.factory = f.id where {where}""",
        "u.time desc nulls first, u.phone, m.factory nulls first",
    )


def coin_ledger(where: str = "true", base: str = "true") -> Body:
    return Body(
        f"""u.phone, u.name, {url('u.image')} as image, r.val as dsd_val, r.from_type as type, r.time,
            coalesce(f.name, '') as factory""",
        f"""(select * from fx_coin_records where user_id is not null and {base}) r
            left join fx_user_info u on r.user_id = u.phone left join fx_factory_users m on u.phone = m.phone
            left join fx_factorys f on m.factory = f.id where {where}""",
        "r.time desc nulls first, r.id, m.factory nulls first",
    )


def coin_ledger_shown_total(where: str = "true", base: str = "true") -> str:
    return with_standins(
        f"""select cast(count(*) as bigint) as total from
            (select * from fx_coin_records where user_id is not null and {base}) r
            left join fx_factory_users m on r.user_id = m.phone left join fx_factorys f on m.factory = f.id where {where}"""
    )


def feedback(where: str = "true", base: str = "true") -> Body:
    return Body(
        f"""b.id, b.phone, u.name, {url('u.image')} as image, b.content, b.resp, b.time, b.model, b.system, b.operator,
            {urls_text('b.images')} as images""",
        f"""(select * from fx_user_feedback where phone is not null and time >= 0 and {base}) b
            left join fx_user_info u on b.phone = u.phone where {where}""",
        "b.time desc nulls first, b.id",
    )


def company_applications(user: str = "true", base: str = "true") -> Body:
    return Body(
        f"""e.id, e.name, e.industry, e.region, e.contact, {url('e.image1')} as image1, {url('e.image2')} as image2,
            e.state, e.state_msg, e.time, u.name as username, {url('u.image')} as user_image""",
        f"""(select * from fx_bg_examine where id in (select phone from fx_user_info where name is not null and {user})
            and name is not null and time >= 0 and {base}) e left join fx_user_info u on e.id = u.phone""",
        "e.time desc nulls first, e.id, " + ", ".join(f"e.{x} nulls first" for x in ("name", "industry", "region", "contact", "image1", "image2", "state", "state_msg")),
    )


def apps(where: str = "true") -> Body:
    return Body(
        f"""id, name, slogan, dsd_val, url, {url('icon')} as icon, {text('descs')} as descs,
            {urls_text('images')} as images, state, time""",
        f"fx_tp_apps where {where}",
        "name desc nulls first, id",
    )


def order_sales(where: str = "true", base: str = "true") -> Body:
    return Body(
        """o.id as order_id, c.name as client, u.name as creator, cast(round_even(s.total, 2) as decimal(28, 2)) as sales,
            f.name as company, o.time""",
        f"""(select * from fx_orders where {base}) o left join fx_factory_clients c on o.client_id = c.id
            left join fx_user_info u on o.creator = u.phone
            left join (select order_id, cast(sum(sell_price) as decimal(28, 2)) as total from fx_order_products group by order_id) s
            on s.order_id = o.id left join fx_factorys f on f.id = o.factory where {where}""",
        "o.time desc nulls first, o.id",
    )


_EVENTS = """(select id, time, creator_id as creator from fx_finance_output union
    select id, deliver_time as time, creator from fx_orders union select id, buy_time as time, creator from fx_purchase)"""


def finance_flow(where: str = "true") -> Body:
    return Body(
        """l.type as category, cast(round_even(abs(l.count), 2) as decimal(18, 2)) as sales, l.time as use_time,
            e.time as create_time, u.name as creator, f.name as company,
            case when l.count >= 0 then '收入' when l.count < 0 then '支出' end as input_output""",
        f"""fx_finance_logs l left join {_EVENTS} e on e.id = l.use_id left join fx_user_info u on u.phone = e.creator
            left join fx_factorys f on f.id = l.factory where {where}""",
        "l.time desc nulls first, l.log_key, e.time nulls first, e.creator nulls first",
    )


def purchases(where: str = "true") -> Body:
    return Body(
        """p.material_count as num, cast(round_even(p.total_price, 2) as decimal(18, 2)) as sales, p.buyer, p.buy_time,
            p.putin_time, p.time as create_time, t.name as product, f.name as company,
            cast(round_even(p.total_price, 2) as double) / nullif(cast(p.material_count as double), 0) as price""",
        f"""fx_purchase p left join fx_material_types t on t.id = p.material_type_id
            left join fx_factorys f on p.factory = f.id left join fx_factory_users m on p.creator = m.phone
            left join fx_user_info u on u.name = p.buyer where {where}""",
        "p.time desc nulls first, p.id",
    )


def production(where: str = "true") -> Body:
    return Body(
        """p.name as product, k.complete_count as num, k.start_time, k.complete_time as finished_time,
            u.name as recorder, f.title as company, k.time as create_time""",
        f"""fx_product_task k left join fx_products p on k.product_id = p.id left join fx_factorys f on k.factory = f.id
            left join fx_user_info u on k.creator = u.phone where {where}""",
        "k.time desc nulls first, k.id",
    )


def _stock_branch(number: int, table: str, items: str, log: str, category: str, inout: str, where: str) -> str:
    return f"""select {number} as branch, m.id, m.time as move_time, '{category}' as category, '{inout}' as inout,
        coalesce(nullif(g.time, 0), 0) as time, coalesce(u.name, '') as recorder, coalesce(f.title, '') as company,
        coalesce(m.time, 0) as create_time, m.{items} as items, m.counts
        from fx_{table} m left join fx_user_info u on m.creator_id = u.phone left join fx_factorys f on m.factory = f.id
        left join fx_{log} g on m.id = g.use_id where {where}"""


def stock_union(where: str = "true") -> str:
    return " union all ".join(
        [
            _stock_branch(0, "material_incoming", "materials", "materials_log", "物料", "入库", where),
            _stock_branch(1, "material_outgoing", "materials", "materials_log", "物料", "出库", where),
            _stock_branch(2, "product_incoming", "products", "products_log", "产品", "入库", where),
            _stock_branch(3, "product_outgoing", "products", "products_log", "产品", "出库", where),
        ]
    )


_STOCK_SHOWN = "category, inout, time, recorder, company, create_time"


def stock(where: str = "true") -> Body:
    return Body(_STOCK_SHOWN, f"({stock_union(where)}) s", "branch, move_time desc nulls first, id, time")


def stock_items(where: str = "true", page: tuple[int, int] | None = None) -> str:
    numbered = f"""select *, cast(row_number() over (order by branch, move_time desc nulls first, id, time) as bigint) as rn
        from ({stock_union(where)}) s"""
    cut = "true" if page is None else f"rn > {(page[0] - 1) * page[1]} and rn <= {page[0] * page[1]}"
    key = "id" if page is None else "rn"
    return with_standins(
        f"""select z.{key}, z.category, z.inout, cast(z.i - 1 as int) as pos,
            coalesce(case when z.category = '物料' then t.name else p.name end, '') as name, z.counts[z.i] as number
            from (select n.*, unnest(range(1, least(len(items), len(counts)) + 1)) as i from ({numbered}) n
                where {cut} and items is not null and counts is not null) z
            left join fx_material_types t on cast(t.id as varchar) = z.items[z.i]
            left join fx_products p on cast(p.id as varchar) = z.items[z.i]"""
    )


LEARN_TASKS = f"""select k.id, k.title, k.descr,
    (select array_to_string(list(coalesce(w.keyword, '*') order by x.pos), ',')
        from (select unnest(k.keyword_ids) as item, unnest(range(1, len(k.keyword_ids) + 1)) as pos) x
        left join fx_xd_image_keyword w on cast(w.id as varchar) = x.item) as tags,
    {urls_text('k.images')} as images, k.state, k.time
    from fx_xd_learn_task k"""


def image_tags(where: str = "true") -> Body:
    return Body(
        f"""g.id, g.phone, u.name, w.keyword, {url('w.image')} as image1, {url('g.image')} as image2, g.time, g.state,
            g.err_reason""",
        f"""fx_user_xd_image_tag g left join fx_xd_image_keyword w on g.keyword_id = w.id
            left join fx_user_info u on g.phone = u.phone where u.name is not null and {where}""",
        "g.time desc nulls first, g.id",
    )


def admin_accounts(where: str = "true") -> Body:
    return Body(
        "phone, username, name", f"fx_bg_user where rights = '1' and {where}",
        "time desc nulls first, phone, username",
    )


def companies(where: str = "true") -> Body:
    return Body(
        f"""f.id as factory_id, coalesce(f.name, '') as contact, coalesce(f.title, '') as company_name,
            {text('f.administrators')} as administrators, coalesce(e.industry, '') as company_category,
            coalesce(e.region, '') as company_area, {url('e.image1')} as auth_file, {url('e.image2')} as business_licence,
            cast(coalesce(n.plain, 0) as bigint) as normal_admin""",
        f"""(select * from fx_factorys where {where}) f left join fx_bg_examine e on {text('f.administrators')} = e.id
            left join (select factory, count(phone) as plain from fx_factory_users where rights <> ['1'] group by factory) n
            on n.factory = f.id""",
        "f.time desc nulls first, f.id, e.image1 nulls first, e.image2 nulls first, e.industry nulls first, e.region nulls first",
    )


_RIGHTS = "case r " + " ".join(f"when '{k}' then '{v}'" for k, v in RIGHT_LABELS.items()) + " end"


def _company_admins(factory: str, base: str) -> str:
    return f"""select cast(row_number() over (order by m.time desc nulls first, m.phone, {text('m.rights')}) as bigint) as rn,
        coalesce(m.phone, '') as phone,
        array_to_string(list_filter(list_transform(m.rights, lambda r: {_RIGHTS}), lambda x: x is not null), ',') as permission,
        coalesce(m.factory, '') as factory_id, coalesce(f.title, '') as company,
        case when list_contains(f.administrators, m.phone) then '超级管理员' else '普通管理员' end as role,
        coalesce(u.name, '') as username, {url('u.image')} as avatar, u.name as raw_name
        from (select * from fx_factory_users where factory = '{factory}' and rights <> ['1'] and {base}) m
        left join fx_factorys f on m.factory = f.id left join fx_user_info u on m.phone = u.phone"""


_ADMIN_SHOWN = "rn, phone, permission, factory_id, company, role, username, avatar"


def company_admins_page(factory: str, page: int, row: int, name: str = "true", base: str = "true") -> str:
    return with_standins(
        f"""select {_ADMIN_SHOWN} from ({_company_admins(factory, base)}) t
            where rn > {(page - 1) * row} and {name} order by rn limit {row}"""
    )


def company_admins_total(factory: str, name: str = "true", base: str = "true") -> str:
    return with_standins(f"select cast(count(*) as bigint) as total from ({_company_admins(factory, base)}) t where {name}")


def industry_applications(where: str = "true") -> Body:
    return Body(
        f"""phone, coalesce(company_name, '') as factory, coalesce(industry, '') as industry, coalesce(region, '') as region,
            coalesce(contact_name, '') as contact_name, coalesce(contact_phone, '') as contact_phone,
            coalesce(problems, '') as problems, {text('supplement')} as supplement, time""",
        f"fx_industry_plus_factorys where {where}",
        "time desc nulls first, phone, company_name",
    )


_DEGREES = ", ".join(
    f"case when list_contains(intelligent_degree, '{k}') then '{v}{CAPABILITY_DONE}' else '{v}{CAPABILITY_MISSING}' end"
    for k, v in CAPABILITY_LABELS.items()
)


def industry_tests(where: str = "true") -> Body:
    return Body(
        f"""phone, coalesce(company_name, '') as factory, array_to_string([{_DEGREES}], ',') as intelligent_degree,
            score, time""",
        f"fx_industry_plus_test where {where}",
        "time desc nulls first, phone, company_name",
    )


def invited_companies(where: str = "true") -> Body:
    return Body(
        f"""a.invitor_id as invite_phone, e.name as factory, coalesce({text('f.administrators')}, '') as admin_phone,
            a.time, coalesce(i.name, '') as invite_name,
            case when a.time <= 1552665600 then '0'
                when e.time - a.time <= 5184000 and e.state = '3' then '0' else '1' end as reward""",
        f"""fx_bg_examine e left join fx_user_info a on e.id = a.phone left join fx_user_info i on a.invitor_id = i.phone
            left join fx_factory_users m on e.id = m.phone left join fx_factorys f on m.factory = f.id
            where a.invitor_id is not null and {where}""",
        "a.time desc nulls first, e.id, e.time nulls first, m.factory nulls first",
    )


def invited_friends(where: str = "true") -> Body:
    return Body(
        """u.phone as invited_phone, coalesce(u.name, '') as invited_name, u.invitor_id as invite_phone,
            u.time as invite_time, coalesce(i.name, '') as invite_name, a.time as verify_time,
            case when u.time <= 1552665600 then '0' when a.time is null or a.time = 0 then '1'
                when a.time - u.time <= 2592000 and u.auth_state = 3 then '0' else '1' end as reward""",
        f"""fx_user_info u left join fx_user_info i on u.invitor_id = i.phone left join fx_user_auth a on u.phone = a.phone
            where u.invitor_id is not null and {where}""",
        "u.time desc nulls first, u.phone, a.time nulls first",
    )


BANNERS = Body(f"id, {url('image')} as image, state, time", "fx_bg_banner", "time desc nulls first, id")
