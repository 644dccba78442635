"""The back-office tables and request batches, derived from the given driver tables.

One SELECT per table serves both engines; only the macros differ between them:

* ``EPOCH(x)``  seconds since 1970 of a timestamp without zone
* ``B64(x)``    base64 of a text column's UTF-8 bytes
* ``LIST(``     list constructor
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

_UPLOAD = "concat('data:image/png;base64,', B64({0}))"


def _upload(column: str) -> str:
    return _UPLOAD.format(column)


STATE: dict[str, str] = {
    "user_info": """
        select concat('138', lpad(cast(c_custkey as string), 8, '0')) as phone, case when c_custkey % 17 = 0 then null
        when c_custkey % 40 = 1 then 'Customer#000000001' else c_name end as name, case when c_custkey % 5 = 0 then
        null else concat('img', cast(c_custkey as string)) end as image, cast(c_acctbal as decimal(18, 2)) as coin,
        cast(c_custkey % 4 as int) as auth_state, cast(1550073600 + (c_custkey * 1368787) % 6000000 as bigint) as
        time, case when c_custkey % 3 = 0 then null else concat('138', lpad(cast(c_custkey % 50 as string), 8, '0'))
        end as invitor_id from customer
    """,
    "user_auth": """
        select concat('138', lpad(cast(c_custkey as string), 8, '0')) as phone, c_mktsegment as type, case when
        c_custkey % 11 = 0 then null else c_name end as name, concat('C', cast(c_nationkey as string)) as country,
        cast(1550073600 + (c_custkey * 1368787) % 6000000 + (c_custkey % 60) * 86400 as bigint) as time, case when
        c_custkey % 4 = 0 then null else concat('a', cast(c_custkey as string)) end as image1, concat('b',
        cast(c_custkey as string)) as image2, cast(null as string) as image3, 'pending' as auth_msg from customer
        where c_custkey % 3 <> 1
    """,
    "user_activity_log": """
        select concat('138', lpad(cast(user_id as string), 8, '0')) as phone, EPOCH(ts) as time from events
    """,
    "coin_records": """
        select event_id as id, concat('138', lpad(cast(user_id as string), 8, '0')) as user_id, cast(value as
        decimal(18, 2)) as val, event_type as from_type, EPOCH(ts) as time from events
    """,
    "factorys": """
        select concat('F', cast(s_suppkey as string)) as id, s_name as name, concat('Company ', s_name) as title,
        split(case when s_suppkey % 4 = 0 then concat(concat('138', lpad(cast(s_suppkey as string), 8, '0')), ',',
        concat('138', lpad(cast(s_suppkey + 1 as string), 8, '0'))) else concat('138', lpad(cast(s_suppkey as string),
        8, '0')) end, ',') as administrators, cast(1550073600 + s_suppkey * 7919 as bigint) as time from supplier
    """,
    "factory_users": """
        select concat('138', lpad(cast(c_custkey as string), 8, '0')) as phone, c_name as name, split(case when
        c_custkey % 10 = 0 then '1' else concat('3,', cast(c_custkey % 9 + 1 as string), ',app', cast(c_custkey as
        string)) end, ',') as rights, concat('F', cast(c_custkey % 120 as string)) as factory, cast(1550073600 +
        (c_custkey * 1368787) % 6000000 as bigint) as time from customer where c_custkey % 6 <> 5
    """,
    "bg_examine": """
        select concat('138', lpad(cast(c_custkey as string), 8, '0')) as id, concat('Company ', c_name) as name,
        c_mktsegment as industry, concat('R', cast(c_nationkey as string)) as region, concat('138',
        lpad(cast(c_custkey % 40 as string), 8, '0')) as contact, concat('lic', cast(c_custkey as string)) as image1,
        case when c_custkey % 4 = 0 then null else concat('auth', cast(c_custkey as string)) end as image2, case
        c_custkey % 8 when 0 then '0' when 2 then '1' when 4 then '2' else '3' end as state, '' as state_msg,
        cast(1550073600 + (c_custkey * 1368787) % 6000000 + (c_custkey % 90) * 86400 as bigint) as time from customer
        where c_custkey % 2 = 0
    """,
    "user_feedback": """
        select event_id as id, concat('138', lpad(cast(user_id as string), 8, '0')) as phone, props as content, case
        when event_id % 2 = 0 then null else 'ok' end as resp, EPOCH(ts) as time, 'm1' as model, 'android' as system,
        'op' as operator, case when event_id % 3 = 0 then null else split(concat('f', cast(event_id as string), ',g',
        cast(event_id as string)), ',') end as images from events where event_type = 'error'
    """,
    "orders": """
        select o_orderkey as id, o_custkey as client_id, concat('138', lpad(cast(o_custkey as string), 8, '0')) as
        creator, concat('F', cast(o_orderkey % 120 as string)) as factory, EPOCH(o_orderdate) as time, case when
        o_orderstatus = 'P' then null else EPOCH(o_orderdate) + 604800 end as deliver_time from orders
    """,
    "factory_clients": """
        select c_custkey as id, c_name as name from customer where c_custkey % 13 <> 0
    """,
    "order_products": """
        select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as bigint) as product_count,
        cast(l_extendedprice as decimal(18, 2)) as sell_price from lineitem
    """,
    "products": """
        select p_partkey as id, p_name as name, p_type as unit from part where p_partkey % 19 <> 0
    """,
    "material_types": """
        select p_partkey as id, p_name as name from part where p_partkey % 23 <> 0
    """,
    "purchase": """
        select o_orderkey * 10 + 1 as id, o_orderkey % 2000 as material_type_id, o_orderkey % 50 as material_count,
        cast(o_totalprice as decimal(18, 2)) as total_price, concat('Customer#', lpad(cast(o_custkey as string), 9,
        '0')) as buyer, EPOCH(o_orderdate) as buy_time, EPOCH(o_orderdate) + 86400 as putin_time, EPOCH(o_orderdate) +
        3600 as time, concat('138', lpad(cast(o_custkey as string), 8, '0')) as creator, concat('F', cast(o_orderkey %
        120 as string)) as factory from orders
    """,
    "finance_output": """
        select s_suppkey * 10 + 2 as id, cast(1550073600 + s_suppkey * 7919 as bigint) as time, concat('138',
        lpad(cast(s_suppkey as string), 8, '0')) as creator_id from supplier
    """,
    "finance_logs": """
        select o_orderkey as log_key, o_orderpriority as type, case when o_orderkey % 3 = 0 then -cast(o_totalprice as
        decimal(18, 2)) else cast(o_totalprice as decimal(18, 2)) end as count, EPOCH(o_orderdate) as time, case when
        o_orderkey % 5 = 0 then o_orderkey * 10 + 1 else o_orderkey end as use_id, concat('F', cast(o_orderkey % 120
        as string)) as factory from orders
    """,
    "product_task": """
        select o_orderkey as id, concat('F', cast(o_orderkey % 120 as string)) as factory, o_custkey as product_id,
        o_orderkey % 500 as complete_count, EPOCH(o_orderdate) as start_time, case when o_orderstatus = 'O' then null
        else EPOCH(o_orderdate) + 86400 end as complete_time, concat('138', lpad(cast(o_custkey as string), 8, '0'))
        as creator, EPOCH(o_orderdate) as time from orders
    """,
    "material_incoming": """
        select o_orderkey as id, concat('F', cast(o_orderkey % 120 as string)) as factory, split(case when o_orderkey
        % 7 = 0 then cast(o_custkey as string) else concat(cast(o_orderkey % 2000 as string), ',', cast(o_custkey as
        string)) end, ',') as materials, case when o_orderkey % 29 = 0 then null else split('3,5,8', ',') end as
        counts, EPOCH(o_orderdate) as time, concat('138', lpad(cast(o_custkey as string), 8, '0')) as creator_id from
        orders where o_orderkey % 4 = 0
    """,
    "material_outgoing": """
        select o_orderkey as id, concat('F', cast(o_orderkey % 120 as string)) as factory, split(case when o_orderkey
        % 7 = 0 then cast(o_custkey as string) else concat(cast(o_orderkey % 2000 as string), ',', cast(o_custkey as
        string)) end, ',') as materials, case when o_orderkey % 29 = 0 then null else split('3,5,8', ',') end as
        counts, EPOCH(o_orderdate) as time, concat('138', lpad(cast(o_custkey as string), 8, '0')) as creator_id from
        orders where o_orderkey % 4 = 1
    """,
    "product_incoming": """
        select o_orderkey as id, concat('F', cast(o_orderkey % 120 as string)) as factory, split(case when o_orderkey
        % 7 = 0 then cast(o_custkey as string) else concat(cast(o_orderkey % 2000 as string), ',', cast(o_custkey as
        string)) end, ',') as products, case when o_orderkey % 29 = 0 then null else split('3,5,8', ',') end as
        counts, EPOCH(o_orderdate) as time, concat('138', lpad(cast(o_custkey as string), 8, '0')) as creator_id from
        orders where o_orderkey % 4 = 2
    """,
    "product_outgoing": """
        select o_orderkey as id, concat('F', cast(o_orderkey % 120 as string)) as factory, split(case when o_orderkey
        % 7 = 0 then cast(o_custkey as string) else concat(cast(o_orderkey % 2000 as string), ',', cast(o_custkey as
        string)) end, ',') as products, case when o_orderkey % 29 = 0 then null else split('3,5,8', ',') end as
        counts, EPOCH(o_orderdate) as time, concat('138', lpad(cast(o_custkey as string), 8, '0')) as creator_id from
        orders where o_orderkey % 4 = 3
    """,
    "materials_log": """
        select o_orderkey as use_id, EPOCH(o_orderdate) + 60 as time from orders where o_orderkey % 4 in (0, 1) and
        o_orderkey % 5 <> 0
    """,
    "products_log": """
        select o_orderkey as use_id, EPOCH(o_orderdate) + 60 as time from orders where o_orderkey % 4 in (2, 3) and
        o_orderkey % 5 <> 0
    """,
    "xd_image_keyword": """
        select cast(n_nationkey as bigint) as id, n_name as keyword, case when n_nationkey % 6 = 0 then null else
        concat('k', cast(n_nationkey as string)) end as image, cast(n_regionkey % 2 + 1 as int) as level,
        cast(n_regionkey as string) as parent, cast(1550073600 + n_nationkey as bigint) as time from nation
    """,
    "xd_learn_task": """
        select doc_id as id, source as title, lang as descr, case when doc_id % 9 = 0 then null else
        split(concat(cast(doc_id % 30 as string), ',', cast(doc_id % 7 as string)), ',') end as keyword_ids,
        split(concat('t', cast(doc_id as string)), ',') as images, cast(doc_id % 2 as string) as state,
        cast(1550073600 + doc_id as bigint) as time from documents
    """,
    "user_xd_image_tag": """
        select event_id as id, concat('138', lpad(cast(user_id as string), 8, '0')) as phone, event_id % 30 as
        keyword_id, concat('u', cast(event_id as string)) as image, EPOCH(ts) as time, cast(event_id % 3 as string) as
        state, '' as err_reason from events where event_type = 'click'
    """,
    "industry_plus_factorys": """
        select concat('138', lpad(cast(c_custkey as string), 8, '0')) as phone, concat('Company ', c_name) as
        company_name, c_mktsegment as industry, concat('R', cast(c_nationkey as string)) as region, c_name as
        contact_name, concat('138', lpad(cast(c_custkey as string), 8, '0')) as contact_phone, 'problem' as problems,
        split('s1,s2', ',') as supplement, cast(1550073600 + (c_custkey * 1368787) % 6000000 as bigint) as time from
        customer
    """,
    "industry_plus_test": """
        select concat('138', lpad(cast(c_custkey as string), 8, '0')) as phone, concat('Company ', c_name) as
        company_name, split(concat(cast(c_custkey % 5 + 1 as string), ',', cast(c_custkey % 3 + 1 as string)), ',') as
        intelligent_degree, cast(c_custkey % 100 as double) as score, cast(1550073600 + (c_custkey * 1368787) %
        6000000 as bigint) as time from customer
    """,
    "tp_apps": """
        select concat('app', cast(p_partkey as string)) as id, p_name as name, p_brand as slogan, cast(p_retailprice
        as decimal(18, 2)) as dsd_val, concat('https://example.com/', cast(p_partkey as string)) as url, concat('i',
        cast(p_partkey as string)) as icon, split(concat(p_type, ',', p_brand), ',') as descs, split(concat('p',
        cast(p_partkey as string), ',q', cast(p_partkey as string)), ',') as images, cast(p_partkey % 2 as string) as
        state, cast(1550073600 + p_partkey as bigint) as time from part
    """,
    "user_tp_apps": """
        select o_orderkey as id, concat('F', cast(o_orderkey % 120 as string)) as factory_id from orders where
        o_orderstatus = 'P'
    """,
    "tp_apps_order": """
        select o_orderkey as id, concat('F', cast(o_orderkey % 120 as string)) as factory_id from orders where
        o_orderstatus = 'F'
    """,
    "bg_banner": """
        select concat('bn', cast(n_nationkey as string)) as id, concat('bi', cast(n_nationkey as string)) as image,
        cast(n_nationkey % 2 as string) as state, cast(1550073600 + n_regionkey as bigint) as time from nation
    """,
    "bg_user": """
        select concat('u', cast(c_custkey as string)) as username, case when c_custkey % 250 <> 0 then concat('138',
        lpad(cast(c_custkey as string), 8, '0')) end as phone, c_name as name, case when c_custkey % 50 = 0 then '0' else '1' end as rights, cast(1550073600
        + (c_custkey * 1368787) % 6000000 as bigint) as time from customer
    """,
    "base_clients_pool": """
        select c_name as name, c_name as contacts, concat('138', lpad(cast(c_custkey as string), 8, '0')) as phone,
        c_mktsegment as industry, cast(1550073600 + c_custkey as bigint) as create_time, concat('R', cast(c_nationkey
        as string)) as region, '' as address from customer
    """,
}

REQUESTS: dict[str, str] = {
    "req_identity_review": """
        select event_id as req_id, concat('138', lpad(cast(user_id as string), 8, '0')) as phone, cast(event_id % 4 as
        string) as state, case when event_id % 3 = 0 then '' else props end as msg, EPOCH(ts) as req_time from events
        where event_type = 'signup'
    """,
    "req_coin_grant": """
        select event_id as req_id, case when event_id % 10 = 0 then '12000000000' when event_id % 10 = 1 then
        '13899999999' else concat('138', lpad(cast(user_id as string), 8, '0')) end as phone, case when event_id % 7 =
        0 then -cast(value as decimal(18, 2)) else cast(value as decimal(18, 2)) end as dsd_val, EPOCH(ts) as req_time
        from events where event_type = 'purchase'
    """,
    "req_feedback_reply": """
        select event_id as req_id, event_id as id, case when event_id % 9 = 0 then '' else concat('re: ', props) end
        as msg, EPOCH(ts) as req_time from events where event_type = 'error'
    """,
    "req_application_decision": """
        select c_custkey as req_id, concat('138', lpad(cast(c_custkey as string), 8, '0')) as id, cast(c_custkey % 4
        as int) as state, case when c_custkey % 5 = 0 then '' else 'note' end as state_msg, cast(1550073600 +
        (c_custkey * 1368787) % 6000000 + 86400 as bigint) as req_time from customer
    """,
    "req_image_tag_review": """
        select event_id as req_id, event_id as id, case event_id % 3 when 0 then '0' when 1 then '1' else 'x' end as
        res, 'r' as err_reason, EPOCH(ts) as req_time from events where event_type = 'click'
    """,
    "req_company_new": f"""
        select c_custkey as req_id, concat('Company ', cast(c_custkey % 700 as string)) as company_name, c_name as
        contact, concat('138', lpad(cast(c_custkey % 1100 as string), 8, '0')) as administrators, concat('R',
        cast(c_nationkey as string)) as company_area, c_mktsegment as company_category, cast(1550073600 + (c_custkey *
        1368787) % 6000000 as bigint) as req_time,
        case c_custkey % 3 when 0 then '' when 1 then 'no,!!' else {_upload('c_name')} end as auth_file,
        case when c_custkey % 4 = 1 then null else {_upload('c_mktsegment')} end as business_licence from customer
    """,
    "req_company_delete": """
        select s_suppkey as req_id, concat('F', cast(s_suppkey * 2 as string)) as id from supplier where s_suppkey % 3
        = 0
    """,
    "req_company_admin_change": """
        select c_custkey as req_id, concat('F', cast(c_custkey % 120 as string)) as factory_id, concat('138',
        lpad(cast(c_custkey as string), 8, '0')) as administrators, concat('138', lpad(cast(c_custkey + 7000000 as
        string), 8, '0')) as new_administrators, split('3,5,3', ',') as permission, cast(1550073600 + (c_custkey *
        1368787) % 6000000 as bigint) as req_time from customer
    """,
}

_PHONE = "concat('138', lpad(cast({0} as string), 8, '0'))"


def _phone(number: str) -> str:
    return _PHONE.format(number)


_CUSTOMER_TIME = "cast(1550073600 + (c_custkey * 1368787) % 6000000 as bigint) as req_time"
_EVENT_TIME = "EPOCH(ts) as req_time"

REQUESTS |= {
    "req_application_approval": f"""
        select c_custkey as req_id, {_phone('c_custkey * 3 % 1000')} as id, cast(case when c_custkey % 5 = 0 then c_custkey % 3 else 3 end as int) as state,
            case c_custkey % 4 when 0 then '' when 1 then null else concat('note ', cast(c_custkey as string)) end as state_msg,
            {_CUSTOMER_TIME}
        from customer where c_custkey % 7 <> 0
    """,
    "req_company_admin_swap": f"""
        select c_custkey as req_id, concat('F', cast(c_custkey % 12 as string)) as factory_id,
            case when c_custkey % 37 = 0 then '' else {_phone('c_custkey * 5 % 48')} end as administrators,
            {_phone('c_custkey * 11 % 48')} as new_administrators, split('7,3,7', ',') as permission, {_CUSTOMER_TIME}
        from customer
    """,
    "req_app_new": f"""
        select p_partkey as req_id, p_name as name,
            case when p_partkey % 15 = 0 then '' when p_partkey % 35 = 0 then 'no payload' else {_upload('p_name')} end as icon,
            p_brand as slogan, split(concat(p_type, ',', p_brand), ',') as descs,
            LIST({_upload('p_brand')}, 'bad', {_upload('p_type')}) as images,
            case when p_partkey % 55 = 0 then null else cast(p_retailprice as decimal(18, 2)) end as dsd_val,
            'https://example.com/new' as url, cast(1550073600 + p_partkey as bigint) as req_time
        from part
    """,
    "req_app_modify": f"""
        select p_partkey as req_id, concat('app', cast(p_partkey % 1500 as string)) as id, concat('new ', p_name) as name,
            case when p_partkey % 4 = 0 then '' when p_partkey % 7 = 0 then null else {_upload('p_name')} end as icon,
            p_brand as slogan, split(p_type, ' ') as descs,
            LIST({_upload('p_brand')}, '', concat('keep', cast(p_partkey as string))) as images,
            case when p_partkey % 50 = 0 then null else cast(p_retailprice as decimal(18, 2)) end as dsd_val,
            'https://example.com/m' as url, cast(1550073600 + (p_partkey * 7919) % 100000 as bigint) as req_time
        from part
    """,
    "req_app_state": """
        select p_partkey as req_id, case when p_partkey % 41 = 0 then '' else concat('app', cast(p_partkey * 3 % 2500 as string)) end as id,
            case p_partkey % 5 when 0 then '0' when 1 then '1' when 2 then '2' when 3 then '' else '1' end as state,
            cast(1550073600 + (p_partkey * 7919) % 100000 as bigint) as req_time
        from part
    """,
    "req_learn_task_new": f"""
        select doc_id as req_id, source as title, lang as descr,
            case when doc_id % 21 = 0 then null
                else split(concat(cast(doc_id % 5 as string), ',', cast(doc_id % 3 as string), ',', cast(doc_id % 5 as string)), ',') end as keywords,
            LIST({_upload('source')}, 'bad', {_upload('lang')}) as images, cast(1550073600 + doc_id as bigint) as req_time
        from documents
    """,
    "req_learn_task_state": """
        select doc_id as req_id, doc_id * 2 as id, case doc_id % 4 when 0 then '0' when 1 then '1' when 2 then '7' else '' end as state,
            cast(1550073600 + doc_id as bigint) as req_time
        from documents
    """,
    "req_keyword_new": f"""
        select event_id as req_id, event_id % 40 as type, concat('word ', cast(event_id as string)) as name,
            case when event_id % 3 = 0 then '' when event_id % 5 = 0 then 'bad' else {_upload('event_type')} end as image, {_EVENT_TIME}
        from events where event_type = 'view'
    """,
    "req_tag_delete": f"""
        select event_id as req_id, case when event_id % 11 = 0 then null else event_id end as id, {_EVENT_TIME}
        from events where event_id % 4 = 0
    """,
    "req_account_new": f"""
        select c_custkey as req_id,
            case c_custkey % 4 when 0 then {_phone('c_custkey % 7 * 50')} when 1 then concat('u', cast(c_custkey % 9 * 50 as string))
                when 2 then {_phone('25')} else 'nobody' end as actor,
            case when c_custkey % 13 = 0 then '12345' when c_custkey % 3 = 0 then {_phone('c_custkey')}
                else concat('139', lpad(cast(c_custkey % 200 as string), 8, '0')) end as phone,
            c_name as name, {_CUSTOMER_TIME}
        from customer
    """,
    "req_account_delete": f"""
        select c_custkey as req_id,
            case when c_custkey % 6 = 0 then concat('u', cast(c_custkey % 20 * 50 as string)) else {_phone('c_custkey % 20 * 50')} end as actor,
            case when c_custkey % 17 = 0 then 'u50' else {_phone('c_custkey * 7 % 40 * 25')} end as phone, {_CUSTOMER_TIME}
        from customer
    """,
    "req_account_delete_by_name": f"""
        select c_custkey as req_id, concat('u', cast(c_custkey % 40 * 25 as string)) as actor,
            case when c_custkey % 11 = 0 then null when c_custkey % 3 = 0 then {_phone('c_custkey % 20 * 50')} else 'u50' end as phone,
            {_CUSTOMER_TIME}
        from customer
    """,
    "req_account_rename": f"""
        select c_custkey as req_id, {_phone('c_custkey % 90 * 25')} as phone,
            case when c_custkey % 8 = 0 then null else concat('renamed ', cast(c_custkey as string)) end as new_name, {_CUSTOMER_TIME}
        from customer
    """,
    "req_company_modify": f"""
        select c_custkey as req_id, concat('F', cast(c_custkey % 110 as string)) as factory_id,
            concat('Company ', cast(c_custkey as string)) as company_name,
            concat('Customer#', lpad(cast(c_custkey % 60 as string), 9, '0')) as contact,
            case when c_custkey % 19 = 0 then '123' else {_phone('c_custkey * 7 % 230')} end as administrators,
            concat('R', cast(c_nationkey as string)) as company_area, c_mktsegment as company_category,
            case c_custkey % 3 when 0 then '' when 1 then 'abcdefghijklmnopqr' else {_upload('c_name')} end as auth_file,
            case when c_custkey % 2 = 0 then {_upload('c_mktsegment')} else '' end as business_licence, {_CUSTOMER_TIME}
        from customer
    """,
    "req_company_admin_new": f"""
        select c_custkey as req_id, case when c_custkey % 31 = 0 then '' else concat('F', cast(c_custkey % 120 as string)) end as factory_id,
            case when c_custkey % 23 = 0 then '123' when c_custkey % 2 = 0 then {_phone('c_custkey')} else {_phone('c_custkey % 300 * 6 + 5')} end as new_administrators,
            split('5,3,5', ',') as permission, {_CUSTOMER_TIME}
        from customer
    """,
    "req_company_admin_remove": f"""
        select c_custkey as req_id, concat('F', cast(c_custkey % 600 % 120 as string)) as factory_id,
            case when c_custkey % 29 = 0 then '' else {_phone('c_custkey % 600')} end as administrators, {_CUSTOMER_TIME}
        from customer
    """,
    "req_banner_new": f"""
        select event_id as req_id, case when event_id % 7 = 0 then 'bad' else {_upload('event_type')} end as image, {_EVENT_TIME}
        from events where event_type = 'view'
    """,
    "req_banner_modify": f"""
        select event_id as req_id, concat('bn', cast(event_id % 40 as string)) as id,
            case when event_id % 5 = 0 then cast(event_id % 2 as string) else null end as state,
            case event_id % 4 when 0 then null when 1 then 'https://example.com/x.jpg' when 2 then {_upload('event_type')} else 'bad' end as image,
            {_EVENT_TIME}
        from events where event_type = 'view'
    """,
    "req_banner_delete": f"""
        select event_id as req_id, concat('bn', cast(event_id % 7 * 5 as string)) as id, {_EVENT_TIME}
        from events where event_type = 'view'
    """,
    "req_upload": f"""
        select doc_id as req_id, case doc_id % 6 when 0 then text when 1 then concat('data:text/plain;base64,', B64(text), '!!')
            else concat('data:text/plain;base64,', B64(text)) end as payload
        from documents
    """,
    "old_accounts": """
        select case when c_custkey = 100 then 'admin' else concat('u', cast(c_custkey as string)) end as username, c_custkey as code
        from customer
    """,
}

_DIALECTS = {
    "spark": {
        "EPOCH": r"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', \1)",
        "B64": r"base64(encode(\1, 'UTF-8'))",
        "LIST": "array(",
    },
    "duckdb": {
        "EPOCH": r"date_diff('second', timestamp '1970-01-01 00:00:00', \1)",
        "B64": r"to_base64(encode(\1))",
        "LIST": "list_value(",
    },
}


def sql_text(name: str, dialect: str) -> str:
    text = " ".join((STATE.get(name) or REQUESTS[name]).split())
    words = _DIALECTS[dialect]
    text = re.sub(r"EPOCH\((\w+)\)", words["EPOCH"], text)
    text = re.sub(r"B64\((\w+)\)", words["B64"], text)
    return text.replace("LIST(", words["LIST"])


class StandIns(Mapping[str, DataFrame]):
    """Table access like the other sources, over the driver tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self._folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in STATE and name not in REQUESTS:
            raise KeyError(name)
        text = sql_text(name, "spark")
        text = re.sub(r" from (\w+)( where |$)", rf" from parquet.`{self._folder}/\1.parquet`\2", text)
        return self.spark.sql(text)

    def __iter__(self) -> Iterator[str]:
        return iter([*STATE, *REQUESTS])

    def __len__(self) -> int:
        return len(STATE) + len(REQUESTS)


def with_standins(sql: str) -> str:
    """DuckDB text with a CTE for every ``fx_<name>`` it reads."""
    names = sorted(set(re.findall(r"\bfx_(\w+)\b", sql)))
    ctes = ", ".join(f"fx_{n} as ({sql_text(n, 'duckdb')})" for n in names)
    body = sql.strip()
    if body.startswith("with recursive "):
        return f"with recursive {ctes}, {body.removeprefix('with recursive ')}"
    if body.startswith("with "):
        return f"with {ctes}, {body.removeprefix('with ')}"
    return f"with {ctes} {body}" if ctes else body
