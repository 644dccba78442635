"""Registered job queries (state after the job, rejects, messages) with their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.checks.report_queries import flat
from tallyhouse.checks.standins import StandIns, with_standins
from tallyhouse.constants import PHONE_PATTERN
from tallyhouse.plans import company_changes, company_jobs, content_jobs, review_jobs
from tallyhouse.plans.jobs import JobResult

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REJECTS = "select req_id, reason from r where reason is not null"


def register_job(prefix: str, job: Callable[..., JobResult], batch: str, checked: str, **outputs: tuple[str, str] | str) -> None:
    """``checked`` defines ``r``, the judged requests; every output is (what to read, SQL over ``r``)."""
    for suffix, spec in {"rejects": REJECTS, **outputs}.items():
        what, sql = (suffix, spec) if isinstance(spec, str) else spec

        def query(spark: SparkSession, folder: str, what: str = what) -> DataFrame:
            t = StandIns(spark, folder)
            result = job(t, t[batch])
            frames = {
                "rejects": result.rejected, "messages": result.messages, "discarded": result.discarded,
                "accepted": result.accepted.select("req_id"), "uploads": stored(result.uploads),
            }
            return flat(frames[what] if what in frames else result.table(t, what))

        name = f"{prefix}_{suffix}"
        QUERIES[name] = query
        ORACLES[name] = with_standins(f"with {checked} {sql}")


def stored(uploads: DataFrame | None) -> DataFrame | None:
    """Uploads with a digest in place of their bytes."""
    return uploads and uploads.select("image_id", "size", F.sha2("content", 256).alias("digest"))


def phone_ok(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{PHONE_PATTERN}'), false)"


def lst(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda i: coalesce(i, '*')), ',')"


def digest(job: str, *parts: str) -> str:
    joined = ", ".join(["'" + job + "'", *[f"cast({p} as varchar)" for p in parts]])
    return f"sha256(concat_ws('|', {joined}))"


def short_id(job: str, *parts: str) -> str:
    return f"substr({digest(job, *parts)}, 1, 18)"


def number_id(job: str, *parts: str) -> str:
    return f"cast(('0x' || substr({digest(job, *parts)}, 1, 15)) as bigint)"


_TAIL = "regexp_replace(array_extract(string_split({0}, ','), -1), '[^A-Za-z0-9+/=]', '', 'g')"
_WHOLE = "regexp_extract({0}, '^((?:[A-Za-z0-9+/]{{4}})*(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?)', 1)"


def payload_ok(x: str) -> str:
    """Whether a data URI decodes to something, by the shape of its text."""
    tail = _TAIL.format(x)
    whole = _WHOLE.format(tail)
    return (
        f"(coalesce(contains({x}, ','), false) and {whole} <> '' and (suffix({whole}, '=') "
        f"or regexp_full_match(substr({tail}, length({whole}) + 1), '=*')))"
    )


def uploaded_id(x: str, job: str, *parts: str) -> str:
    return f"case when {payload_ok(x)} then {short_id(job, *parts)} end"


def uploaded_list(x: str, job: str) -> str:
    inner = f"case when {payload_ok('p')} then {short_id(job, 'req_id', 'i - 1')} end"
    return f"list_filter(list_transform({x}, lambda p, i: {inner}), lambda z: z is not null)"


def upload_rows(x: str, job: str, where: str = "reason is null", many: bool = False) -> str:
    """What the accepted requests store of one payload column."""
    source = f"(select *, {x} as p from r where {where})"
    if many:
        source = f"(select *, unnest({x}) as p, generate_subscripts({x}, 1) - 1 as i from r where {where})"
    content = f"from_base64({_WHOLE.format(_TAIL.format('p'))})"
    return f"""select {short_id(job, 'req_id', *(['i'] if many else []))} as image_id,
        cast(octet_length({content}) as bigint) as size, sha256({content}) as digest from {source} z where {payload_ok('p')}"""


def latest(keys: str, where: str = "reason is null", source: str = "r") -> str:
    return (
        f"select * from {source} where {where} "
        f"qualify row_number() over (partition by {keys} order by req_time desc, req_id desc) = 1"
    )


# J01
_J01 = """r as (select *, case when phone is null or phone = '' then 'missing id'
    when state is null or state not in ('0', '2', '3') then 'bad state'
    when phone not in (select phone from fx_user_info) then 'unknown user' end as reason,
    case when msg is null or msg = '' then '认证未通过' else msg end as note from fx_req_identity_review),
    l as (select * from r where reason is null and state in ('2', '3')
        qualify row_number() over (partition by phone order by req_time desc, req_id desc) = 1)"""
register_job(
    "j01", review_jobs.review_identity, "req_identity_review", _J01,
    users=(
        "user_info",
        """select u.* replace (coalesce(cast(l.state as integer), u.auth_state) as auth_state)
            from fx_user_info u left join l on u.phone = l.phone""",
    ),
    papers=(
        "user_auth",
        """select a.* replace (case l.state when '3' then '认证通过' when '2' then l.note else a.auth_msg end as auth_msg)
            from fx_user_auth a left join l on a.phone = l.phone""",
    ),
    messages="""select req_id, cast(json_object('resource', 'BgAuth', 'type', 'POST', 'params',
        json_object('id', phone, 'state', state, 'msg', note)) as varchar) as value from r where reason is null""",
)

# J02
_J02 = f"""r as (select *, case when not {phone_ok('phone')} then 'bad phone' when dsd_val is null or dsd_val <= 0 then 'bad value'
    when (select count(*) from fx_user_info u where u.phone = q.phone) <> 1 then 'unknown account' end as reason
    from fx_req_coin_grant q)"""
register_job(
    "j02", review_jobs.grant_coins, "req_coin_grant", _J02,
    ledger=(
        "coin_records",
        f"""select id, user_id, val, from_type, time from fx_coin_records union all
            select {number_id('grant_coins', 'req_id')}, phone, dsd_val, 'system', req_time from r where reason is null""",
    ),
    users=(
        "user_info",
        """select u.* replace (cast(u.coin + coalesce(g.s, 0) as decimal(18, 2)) as coin) from fx_user_info u
            left join (select phone, sum(dsd_val) as s from r where reason is null group by phone) g on u.phone = g.phone""",
    ),
    messages="""select req_id, cast(json_object('resource', 'BgDSDGrant', 'type', 'POST', 'params',
        json_object('id', phone, 'dsd_val', cast(dsd_val as double))) as varchar) as value from r where reason is null""",
)

# J03
_J03 = """r as (select *, case when id is null then 'missing id' when msg is null or msg = '' then 'missing message' end as reason
    from fx_req_feedback_reply)"""
register_job(
    "j03", review_jobs.reply_feedback, "req_feedback_reply", _J03,
    feedback=(
        "user_feedback",
        f"""select f.* replace (coalesce(l.msg, f.resp) as resp, {lst('f.images')} as images)
            from fx_user_feedback f left join ({latest('id')}) l on f.id = l.id""",
    ),
    messages=r"""select req_id, cast(json_object('resource', 'BgFeedbackResp', 'type', 'POST', 'params',
        json_object('id', cast(id as varchar), 'msg', replace(replace(replace(msg, '''', ''''''), '\''', ''''), '\"', '"')))
        as varchar) as value from r where reason is null""",
)

# J04
_J04 = f"""r as (select q.*, case when q.id is null or q.id = '' then 'missing id' when q.state is null then 'missing state'
        when q.state = 3 and e.id is null then 'unknown application' end as reason,
        e.name as form_name, e.industry, e.region, e.contact, {short_id('decide_applications', 'q.req_id')} as cid
        from fx_req_application_decision q left join fx_bg_examine e on q.id = e.id),
    s as ({latest('id')}),
    n as (select id, state_msg from r where reason is null and state_msg <> ''
        qualify row_number() over (partition by id order by req_time desc, req_id desc) = 1),
    a as (select * from r where reason is null and state = 3)"""
_J04_OUTPUTS = dict(
    applications=(
        "bg_examine",
        """select e.* replace (coalesce(cast(s.state as varchar), e.state) as state, coalesce(n.state_msg, e.state_msg) as state_msg)
            from fx_bg_examine e left join s on e.id = s.id left join n on e.id = n.id""",
    ),
    companies=(
        "factorys",
        f"""select id, name, title, {lst('administrators')} as administrators, time from fx_factorys union all
            select cid, coalesce(form_name, ''), coalesce(form_name, ''), id, req_time from a""",
    ),
    members=(
        "factory_users",
        f"""select phone, name, {lst('rights')} as rights, factory, time from fx_factory_users union all
            select id, null, '1', cid, req_time from a""",
    ),
    clients=(
        "base_clients_pool",
        """select name, contacts, phone, industry, create_time, region, address from fx_base_clients_pool union all
            select coalesce(a.form_name, ''), coalesce(u.name, ''), coalesce(a.contact, ''), coalesce(a.industry, ''),
            a.req_time, coalesce(a.region, ''), '' from a left join fx_user_info u on a.contact = u.phone""",
    ),
    messages="""select req_id, cast(json_object('resource', 'BgExamine', 'type', 'POST', 'params',
        json_object('id', id, 'state', state, 'state_msg', coalesce(state_msg, ''))) as varchar) as value from a""",
)
for _prefix, _batch in (("j04", "req_application_decision"), ("j04_approvals", "req_application_approval")):
    register_job(
        _prefix, review_jobs.decide_applications, _batch, _J04.replace("req_application_decision", _batch), **_J04_OUTPUTS
    )

# J02: after the grants every ledger row has an id of its own.
def _ledger_ids(spark: SparkSession, folder: str) -> DataFrame:
    t = StandIns(spark, folder)
    ledger = review_jobs.grant_coins(t, t["req_coin_grant"]).table(t, "coin_records")
    return ledger.groupBy("id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("ids"))


QUERIES["j02_ledger_ids"] = _ledger_ids
ORACLES["j02_ledger_ids"] = ORACLES["j02_ledger"].replace("select id, user_id", "select cast(1 as bigint) as n, cast(count(*) as bigint) as ids from (select id, user_id", 1) + ") z"

# J05
_J05 = f"""r as (select *, case when icon is null or icon = '' then 'missing icon' when not {payload_ok('icon')} then 'bad icon'
    when images is null or descs is null or dsd_val is null then 'missing parameter' end as reason from fx_req_app_new)"""
register_job(
    "j05", content_jobs.add_apps, "req_app_new", _J05,
    uploads=f"{upload_rows('icon', 'add_apps.icon')} union all {upload_rows('images', 'add_apps.image', many=True)}",
    apps=(
        "tp_apps",
        f"""select id, name, slogan, dsd_val, url, icon, {lst('descs')} as descs, {lst('images')} as images, state, time from fx_tp_apps
            union all select {short_id('add_apps', 'req_id')}, coalesce(name, ''), coalesce(slogan, ''), dsd_val, url,
            {short_id('add_apps.icon', 'req_id')}, {lst('descs')}, {lst(uploaded_list('images', 'add_apps.image'))}, '0', req_time
            from r where reason is null""",
    ),
)

# J06
_KEPT = f"""list_filter(list_transform(coalesce(images, []), lambda p, i: case when p is null or p = '' then null
    when {payload_ok('p')} then {short_id('modify_apps.image', 'req_id', 'i - 1')} else p end), lambda z: z is not null)"""
_J06 = f"""r as (select *, case when id is null or id = '' then 'missing id' when dsd_val is null then 'bad value' end as reason
        from fx_req_app_modify),
    l as ({latest('id')}),
    ic as (select id, {short_id('modify_apps.icon', 'req_id')} as icon from r where reason is null and {payload_ok('icon')}
        qualify row_number() over (partition by id order by req_time desc, req_id desc) = 1)"""
register_job(
    "j06", content_jobs.modify_apps, "req_app_modify", _J06,
    uploads=f"{upload_rows('icon', 'modify_apps.icon')} union all {upload_rows('images', 'modify_apps.image', many=True)}",
    apps=(
        "tp_apps",
        f"""select a.id, case when l.id is null then a.name else l.name end as name,
            case when l.id is null then a.slogan else l.slogan end as slogan,
            case when l.id is null then a.dsd_val else l.dsd_val end as dsd_val,
            case when l.id is null then a.url else l.url end as url, coalesce(ic.icon, a.icon) as icon,
            case when l.id is null then {lst('a.descs')} else {lst('l.descs')} end as descs,
            case when l.id is null then {lst('a.images')} else {lst(_KEPT.replace('images, []', 'l.images, []').replace('req_id', 'l.req_id'))} end as images,
            a.state, a.time
            from fx_tp_apps a left join l on a.id = l.id left join ic on a.id = ic.id""",
    ),
)


# J07, J09
def _state_checked(batch: str, table: str) -> str:
    return f"""r as (select *, case when id is null or cast(id as varchar) = '' then 'missing id'
        when state is null or state = '' then 'missing state' when state not in ('0', '1') then 'bad state'
        when id not in (select id from fx_{table}) then 'unknown id' end as reason from fx_{batch}), l as ({latest('id')})"""


register_job(
    "j07", content_jobs.set_app_states, "req_app_state", _state_checked("req_app_state", "tp_apps"),
    apps=(
        "tp_apps",
        f"""select a.* replace (coalesce(l.state, a.state) as state, {lst('a.descs')} as descs, {lst('a.images')} as images)
            from fx_tp_apps a left join l on a.id = l.id""",
    ),
)
register_job(
    "j09", content_jobs.set_learn_task_states, "req_learn_task_state",
    _state_checked("req_learn_task_state", "xd_learn_task"),
    tasks=(
        "xd_learn_task",
        f"""select a.* replace (coalesce(l.state, a.state) as state, {lst('a.keyword_ids')} as keyword_ids, {lst('a.images')} as images)
            from fx_xd_learn_task a left join l on a.id = l.id""",
    ),
)

# J08
_J08 = """r as (select *, case when keywords is null or images is null then 'missing parameter' end as reason
    from fx_req_learn_task_new)"""
register_job(
    "j08", content_jobs.add_learn_tasks, "req_learn_task_new", _J08,
    uploads=upload_rows("images", "add_learn_tasks.image", many=True),
    tasks=(
        "xd_learn_task",
        f"""select id, title, descr, {lst('keyword_ids')} as keyword_ids, {lst('images')} as images, state, time from fx_xd_learn_task
            union all select {number_id('add_learn_tasks', 'req_id')}, coalesce(title, ''), coalesce(descr, ''),
            {lst('list_sort(list_distinct(keywords))')}, {lst(uploaded_list('images', 'add_learn_tasks.image'))}, null, req_time
            from r where reason is null""",
    ),
)

# J10
_J10 = """r as (select q.*, p.level as parent_level,
    case when coalesce(q.type, 0) <> 0 and p.id is null then 'unknown parent' end as reason
    from fx_req_keyword_new q left join fx_xd_image_keyword p on q.type = p.id)"""
register_job(
    "j10", content_jobs.add_tag_keywords, "req_keyword_new", _J10,
    uploads=upload_rows("image", "add_tag_keywords.image"),
    keywords=(
        "xd_image_keyword",
        f"""select id, keyword, image, level, parent, time from fx_xd_image_keyword union all
            select {number_id('add_tag_keywords', 'req_id')}, coalesce(name, ''),
            case when image is null or image = '' then '' else {uploaded_id('image', 'add_tag_keywords.image', 'req_id')} end,
            case when coalesce(type, 0) = 0 then 1 else parent_level end, cast(coalesce(type, 0) as varchar), req_time
            from r where reason is null""",
    ),
)

# J11, J12
_J11 = f"""r as (select *, case when id is null then 'missing id' when res is null or res not in ('0', '1') then 'bad res' end as reason
    from fx_req_image_tag_review), l as ({latest('id')})"""
register_job(
    "j11", review_jobs.review_image_tags, "req_image_tag_review", _J11,
    tags=(
        "user_xd_image_tag",
        """select t.* replace (case l.res when '1' then '2' when '0' then '1' else t.state end as state,
            case when l.id is null then t.err_reason else coalesce(l.err_reason, '') end as err_reason)
            from fx_user_xd_image_tag t left join l on t.id = l.id""",
    ),
    messages="""select req_id, cast(json_object('resource', 'BgXDImagesTag', 'type', 'PUT', 'params',
        json_object('id', cast(id as varchar), 'res', res, 'err_reason', coalesce(err_reason, ''))) as varchar) as value
        from r where reason is null""",
)
register_job(
    "j12", review_jobs.delete_image_tags, "req_tag_delete",
    "r as (select *, case when id is null then 'missing id' end as reason from fx_req_tag_delete)",
    tags=(
        "user_xd_image_tag",
        "select * from fx_user_xd_image_tag where id not in (select id from r where reason is null)",
    ),
)

# J13
_J13 = f"""q as (select a.*, {phone_ok('a.phone')} as okp,
        exists (select 1 from fx_bg_user b where b.phone = a.phone) as used,
        exists (select 1 from fx_bg_user b where b.rights = '0'
            and case when regexp_full_match(a.actor, '\\d{{11}}') then b.phone else b.username end = a.actor) as allowed
        from fx_req_account_new a),
    w as (select phone, min((req_time, req_id)) as won from q where okp and not used and allowed group by phone),
    r as (select q.*, case when not okp then 'bad phone' when used or coalesce(w.won < (q.req_time, q.req_id), false) then 'phone in use'
        when not allowed then 'not allowed' end as reason from q left join w on q.phone = w.phone)"""
register_job(
    "j13", company_jobs.add_admin_accounts, "req_account_new", _J13,
    accounts=(
        "bg_user",
        f"""select username, phone, name, rights, time from fx_bg_user union all
            select substr({short_id('add_admin_accounts', 'req_id')}, 1, 11), phone, coalesce(name, ''), '1', req_time
            from r where reason is null""",
    ),
)

# J14: one request after the other, keeping the list of accounts already deleted.
def _j14(batch: str) -> str:
    return f"""recursive s as (select phone as sp, username as su from fx_bg_user where rights = '0'),
    q as (select a.*, case when {phone_ok('a.phone')} then (select min(sp) from s where sp = a.actor)
            else (select case when bool_and(sp is not null) then min(sp) end from s where su = a.actor) end as who,
        case when {phone_ok('a.phone')} then exists (select 1 from s where sp = a.actor)
            else exists (select 1 from s where su = a.actor) end as known,
        row_number() over (order by req_time, req_id) as n from fx_{batch} a),
    run(n, gone, req_id, ok) as (
        select cast(0 as bigint), cast([] as varchar[]), cast(null as bigint), false
        union all
        select q.n, case when q.known and not coalesce(list_contains(run.gone, q.who), false) and not list_contains(run.gone, q.phone)
                then list_append(run.gone, q.phone) else run.gone end,
            q.req_id, q.known and not coalesce(list_contains(run.gone, q.who), false)
        from run join q on q.n = run.n + 1),
    r as (select q.req_id, q.phone, case when q.phone is null then 'missing phone' when not run.ok then 'not allowed' end as reason
        from q join run on q.req_id = run.req_id)"""


_J14_ACCOUNTS = (
    "bg_user", "select * from fx_bg_user where phone is null or phone not in (select phone from r where reason is null)",
)
register_job("j14", company_jobs.delete_admin_accounts, "req_account_delete", _j14("req_account_delete"), accounts=_J14_ACCOUNTS)
# Actors that sign in by name, some of them accounts without a phone.
register_job(
    "j14_no_phone", company_jobs.delete_admin_accounts, "req_account_delete_by_name", _j14("req_account_delete_by_name"),
    accounts=_J14_ACCOUNTS,
)

# J15
_J15 = f"r as (select *, null as reason from fx_req_account_rename), l as ({latest('phone')})"
register_job(
    "j15", company_jobs.rename_admin_accounts, "req_account_rename", _J15,
    accounts=(
        "bg_user",
        """select b.* replace (case when l.req_id is null then b.name else coalesce(l.new_name, '') end as name)
            from fx_bg_user b left join l on b.phone = l.phone""",
    ),
)
del QUERIES["j15_rejects"], ORACLES["j15_rejects"]

def new_file(x: str) -> str:
    return f"case when coalesce({x}, '') = '' then '' else {uploaded_id(x, f'add_companies.{x}', 'req_id')} end"


# J16: one request after the other, keeping the administrators and titles already taken.
_J16 = f"""recursive q as (select a.*, case when coalesce(company_name, '') = '' or coalesce(contact, '') = '' or coalesce(administrators, '') = ''
            then 'missing parameter' when not {phone_ok('administrators')} then 'bad phone'
            when exists (select 1 from fx_factorys f where f.administrators = [a.administrators])
                or exists (select 1 from fx_factory_users m where m.phone = a.administrators) then 'phone belongs to a company'
            when exists (select 1 from fx_factorys f where f.title = a.company_name) then 'company name in use' end as fixed
        from fx_req_company_new a),
    o as (select *, row_number() over (order by req_time, req_id) as n from q where fixed is null),
    run(n, admins, titles, req_id, why) as (
        select cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), cast(null as bigint), cast(null as varchar)
        union all
        select o.n,
            case when list_contains(run.admins, o.administrators) or list_contains(run.titles, o.company_name) then run.admins
                else list_append(run.admins, o.administrators) end,
            case when list_contains(run.admins, o.administrators) or list_contains(run.titles, o.company_name) then run.titles
                else list_append(run.titles, o.company_name) end,
            o.req_id, case when list_contains(run.admins, o.administrators) then 'phone belongs to a company'
                when list_contains(run.titles, o.company_name) then 'company name in use' end
        from run join o on o.n = run.n + 1),
    r as (select q.*, coalesce(q.fixed, run.why) as reason, {short_id('add_companies', 'q.req_id')} as cid
        from q left join run on q.req_id = run.req_id)"""
register_job(
    "j16", company_jobs.add_companies, "req_company_new", _J16,
    uploads=" union all ".join(upload_rows(x, f"add_companies.{x}") for x in ("auth_file", "business_licence")),
    companies=(
        "factorys",
        f"""select id, name, title, {lst('administrators')} as administrators, time from fx_factorys union all
            select cid, contact, company_name, administrators, req_time from r where reason is null""",
    ),
    members=(
        "factory_users",
        f"""select phone, name, {lst('rights')} as rights, factory, time from fx_factory_users union all
            select administrators, null, '1', cid, req_time from r where reason is null""",
    ),
    applications=(
        "bg_examine",
        f"""select id, name, industry, region, contact, image1, image2, state, state_msg, time from fx_bg_examine union all
            select administrators, company_name, coalesce(company_category, ''), coalesce(company_area, ''), administrators,
            {new_file('auth_file')}, {new_file('business_licence')}, null, null, req_time from r where reason is null""",
    ),
)

# J17
_J17 = """r as (select *, case when id is null or id = '' then 'missing id' when id not in (select id from fx_factorys)
    or row_number() over (partition by id order by req_id) > 1 then 'unknown company' end as reason from fx_req_company_delete),
    d as (select id from r where reason is null),
    x as (select unnest(administrators) as phone from fx_factorys where id in (select id from d))"""
register_job(
    "j17", company_jobs.delete_companies, "req_company_delete", _J17,
    companies=(
        "factorys",
        f"""select id, name, title, {lst('administrators')} as administrators, time from fx_factorys
            where id not in (select id from d)""",
    ),
    applications=("bg_examine", "select * from fx_bg_examine where id not in (select phone from x)"),
    user_apps=("user_tp_apps", "select * from fx_user_tp_apps where factory_id not in (select id from d)"),
    app_orders=("tp_apps_order", "select * from fx_tp_apps_order where factory_id not in (select id from d)"),
    members=(
        "factory_users",
        f"""select phone, name, {lst('rights')} as rights, factory, time from fx_factory_users
            where factory not in (select id from d)""",
    ),
)

# J18: one request after the other, keeping who administers each company alone and who is a member where.
def _file_id(x: str) -> str:
    upload = uploaded_id(x, f"modify_companies.{x}", "req_id")
    return f"case when coalesce({x}, '') = '' then '' when length({x}) = 18 then {x} else {upload} end"


_J18 = f"""recursive q as (select a.*, case when coalesce(factory_id, '') = '' then 'missing company id'
            when not {phone_ok('administrators')} then 'bad phone'
            when factory_id not in (select id from fx_factorys) then 'unknown company' end as fixed from fx_req_company_modify a),
    o as (select *, row_number() over (order by req_time, req_id) as n from q where fixed is null),
    run(n, adm, mem, req_id, ok) as (
        select cast(0 as bigint), (select list(id || '|' || administrators[1]) from fx_factorys where len(administrators) = 1),
            (select list(phone || '|' || factory) from fx_factory_users where phone in (select administrators from o)),
            cast(null as bigint), false
        union all
        select n, case when good then list_append(list_filter(adm, lambda z: split_part(z, '|', 1) <> f), f || '|' || x) else adm end,
            case when good then list_append(list_filter(mem, lambda z: z <> x || '|' || f), x || '|' || f) else mem end, req_id, good
        from (select o.n, run.adm, run.mem, o.req_id, o.factory_id as f, o.administrators as x,
                len(list_filter(run.adm, lambda z: split_part(z, '|', 2) = o.administrators)) <= 1
                and len(list_filter(run.mem, lambda z: split_part(z, '|', 1) = o.administrators)) <= 1 as good
            from run join o on o.n = run.n + 1) step),
    r as (select q.*, coalesce(q.fixed, case when not run.ok then 'phone belongs to other companies' end) as reason
        from q left join run on q.req_id = run.req_id),
    fc as ({latest('factory_id')}), pr as ({latest('factory_id, administrators')}), fm as ({latest('administrators')})"""
register_job(
    "j18", company_changes.modify_companies, "req_company_modify", _J18,
    uploads=" union all ".join(
        upload_rows(x, f"modify_companies.{x}", f"reason is null and length({x}) <> 18") for x in ("auth_file", "business_licence")
    ),
    companies=(
        "factorys",
        f"""select f.id, case when c.req_id is null then f.name else c.contact end as name,
            case when c.req_id is null then f.title else c.company_name end as title,
            case when c.req_id is null then {lst('f.administrators')} else c.administrators end as administrators,
            coalesce(c.req_time, f.time) as time from fx_factorys f left join fc c on f.id = c.factory_id""",
    ),
    members=(
        "factory_users",
        f"""select phone, name, {lst('rights')} as rights, factory, time from fx_factory_users m
            where not exists (select 1 from pr where pr.factory_id = m.factory and pr.administrators = m.phone)
            union all select administrators, contact, '1', factory_id, req_time from pr""",
    ),
    applications=(
        "bg_examine",
        f"""select e.id, case when m.req_id is null then e.name else m.company_name end as name,
            case when m.req_id is null then e.industry else coalesce(m.company_category, '') end as industry,
            case when m.req_id is null then e.region else coalesce(m.company_area, '') end as region,
            case when m.req_id is null then e.contact
                else coalesce((select min(u.phone) from fx_user_info u where u.name = m.contact), m.administrators) end as contact,
            case when m.req_id is null then e.image1 else m.file1 end as image1,
            case when m.req_id is null then e.image2 else m.file2 end as image2, e.state, e.state_msg,
            coalesce(m.req_time, e.time) as time
            from fx_bg_examine e left join (select *, {_file_id('auth_file')} as file1, {_file_id('business_licence')} as file2 from fm) m
            on e.id = m.administrators""",
    ),
    messages="""select req_id, cast(json_object('resource', 'BgFacsModify', 'type', 'POST', 'params', json_object('id', factory_id,
        'name', contact, 'title', company_name, 'administrators', administrators)) as varchar) as value from r where reason is null""",
)

# J19
_J19 = f"""q as (select a.*, (select count(*) from fx_factory_users m where m.phone = a.new_administrators) as held,
        coalesce(factory_id, '') <> '' and coalesce(new_administrators, '') <> '' and coalesce(len(permission), 0) > 0 as given
        from fx_req_company_admin_new a),
    r as (select *, case when not given then 'missing parameter' when not {phone_ok('new_administrators')} then 'bad phone'
        when held = 1 or (held = 0 and row_number() over (partition by new_administrators, given order by req_time, req_id) > 1)
        then 'phone in use' end as reason from q)"""
register_job(
    "j19", company_jobs.add_company_admins, "req_company_admin_new", _J19,
    members=(
        "factory_users",
        f"""select phone, name, {lst('rights')} as rights, factory, time from fx_factory_users union all
            select r.new_administrators, coalesce(u.name, ''), {lst('list_sort(list_distinct(r.permission))')}, r.factory_id, r.req_time
            from r left join fx_user_info u on r.new_administrators = u.phone where r.reason is null""",
    ),
)

# J20
_J20 = """r as (select *, case when coalesce(factory_id, '') = '' or coalesce(administrators, '') = ''
    or coalesce(new_administrators, '') = '' or coalesce(len(permission), 0) = 0 then 'missing parameter' end as reason
    from fx_req_company_admin_change)"""
_J20_OUTPUTS = dict(
    members=(
        "factory_users",
        f"""select phone, name, {lst('rights')} as rights, factory, time from fx_factory_users m
            where not exists (select 1 from r where reason is null and r.factory_id = m.factory and r.administrators = m.phone)
            union all
            select r.new_administrators, coalesce(u.name, ''), {lst('list_sort(list_distinct(r.permission))')}, r.factory_id, r.req_time
            from r left join fx_user_info u on r.administrators = u.phone where r.reason is null
            and not exists (select 1 from r x where x.reason is null and x.factory_id = r.factory_id
                and x.administrators = r.new_administrators and (x.req_time, x.req_id) > (r.req_time, r.req_id))""",
    ),
)
for _prefix, _batch in (("j20", "req_company_admin_change"), ("j20_chain", "req_company_admin_swap")):
    register_job(
        _prefix, company_jobs.change_company_admins, _batch, _J20.replace("req_company_admin_change", _batch), **_J20_OUTPUTS
    )

# J21
_J21 = """r as (select *, case when coalesce(factory_id, '') = '' or coalesce(administrators, '') = '' then 'missing parameter'
    when not exists (select 1 from fx_factory_users m where m.factory = a.factory_id and m.phone = a.administrators)
        or row_number() over (partition by factory_id, administrators order by req_time, req_id) > 1 then 'not a member' end as reason
    from fx_req_company_admin_remove a)"""
register_job(
    "j21", company_jobs.remove_company_admins, "req_company_admin_remove", _J21,
    members=(
        "factory_users",
        f"""select phone, name, {lst('rights')} as rights, factory, time from fx_factory_users m
            where not exists (select 1 from r where reason is null and r.factory_id = m.factory and r.administrators = m.phone)""",
    ),
)

# J22
_J22 = f"r as (select *, case when not {payload_ok('image')} then 'bad image' end as reason from fx_req_banner_new)"
register_job(
    "j22", content_jobs.add_banners, "req_banner_new", _J22,
    uploads=upload_rows("image", "add_banners.image"),
    banners=(
        "bg_banner",
        f"""select id, image, state, time from fx_bg_banner union all
            select {short_id('add_banners', 'req_id')}, {short_id('add_banners.image', 'req_id')}, '1', req_time
            from r where reason is null""",
    ),
)

# J23
_J23 = f"""q as (select *, state is null and image is not null and not contains(image, 'https://') as pic from fx_req_banner_modify),
    r as (select *, case when state is null and image is null then 'nothing to change'
        when pic and id not in (select id from fx_bg_banner) then 'unknown banner'
        when pic and not {payload_ok('image')} then 'bad image' end as reason,
        {short_id('modify_banners.image', 'req_id')} as new_image from q),
    st as ({latest('id', 'reason is null and state is not null')}),
    im as ({latest('id', 'reason is null and pic')})"""
register_job(
    "j23", content_jobs.modify_banners, "req_banner_modify", _J23,
    uploads=upload_rows("image", "modify_banners.image", "reason is null and pic"),
    banners=(
        "bg_banner",
        """select b.* replace (coalesce(st.state, b.state) as state, coalesce(im.new_image, b.image) as image)
            from fx_bg_banner b left join st on b.id = st.id left join im on b.id = im.id""",
    ),
    discarded="""select b.image from fx_bg_banner b where b.id in (select id from im) union all
        select new_image as image from r where reason is null and pic and req_id not in (select req_id from im)""",
)

# J24
_J24 = """r as (select *, case when id not in (select id from fx_bg_banner)
    or row_number() over (partition by id order by req_time, req_id) > 1 then 'unknown banner' end as reason
    from fx_req_banner_delete), d as (select id from r where reason is null)"""
register_job(
    "j24", content_jobs.delete_banners, "req_banner_delete", _J24,
    banners=("bg_banner", "select * from fx_bg_banner where id not in (select id from d)"),
    discarded="select image from fx_bg_banner where id in (select id from d)",
)


# J25
def _images(spark: SparkSession, folder: str) -> DataFrame:
    decoded = content_jobs.decode_image_payloads(StandIns(spark, folder)["req_upload"], "req_id", "payload")
    return decoded.select("owner", "image_id", "size")


QUERIES["j25_images"] = _images
_TEXT = _TAIL.format("payload")
ORACLES["j25_images"] = with_standins(
    f"""select req_id as owner, case when ok then {short_id('image', 'req_id')} end as image_id,
        case when ok then cast(octet_length(from_base64(whole)) as bigint) end as size
        from (select req_id, {payload_ok('payload')} as ok, {_WHOLE.format(_TEXT)} as whole from fx_req_upload) z"""
)
