"""Declared schemas, declared unique keys and sort tie-breaks of every table."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_I = T.IntegerType()
_L = T.LongType()
_D = T.DoubleType()
_M = T.DecimalType(18, 2)
_A = T.ArrayType(_S)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_MATERIAL_MOVE = _table(id=_L, factory=_S, materials=_A, counts=_A, time=_L, creator_id=_S)
_PRODUCT_MOVE = _table(id=_L, factory=_S, products=_A, counts=_A, time=_L, creator_id=_S)

TABLES: dict[str, T.StructType] = {
    "user_info": _table(phone=_S, name=_S, image=_S, coin=_M, auth_state=_I, time=_L, invitor_id=_S),
    "user_auth": _table(
        phone=_S, type=_S, name=_S, country=_S, time=_L, image1=_S, image2=_S, image3=_S, auth_msg=_S
    ),
    "user_activity_log": _table(phone=_S, time=_L),
    "coin_records": _table(id=_L, user_id=_S, val=_M, from_type=_S, time=_L),
    "user_feedback": _table(
        id=_L, phone=_S, content=_S, resp=_S, time=_L, model=_S, system=_S, operator=_S, images=_A
    ),
    "bg_examine": _table(
        id=_S, name=_S, industry=_S, region=_S, contact=_S, image1=_S, image2=_S, state=_S, state_msg=_S, time=_L
    ),
    "factorys": _table(id=_S, name=_S, title=_S, administrators=_A, time=_L),
    "factory_users": _table(phone=_S, name=_S, rights=_A, factory=_S, time=_L),
    "base_clients_pool": _table(
        name=_S, contacts=_S, phone=_S, industry=_S, create_time=_L, region=_S, address=_S
    ),
    "tp_apps": _table(
        id=_S, name=_S, slogan=_S, dsd_val=_M, url=_S, icon=_S, descs=_A, images=_A, state=_S, time=_L
    ),
    "user_tp_apps": _table(id=_L, factory_id=_S),
    "tp_apps_order": _table(id=_L, factory_id=_S),
    "orders": _table(id=_L, client_id=_L, creator=_S, factory=_S, time=_L, deliver_time=_L),
    "factory_clients": _table(id=_L, name=_S),
    "order_products": _table(order_id=_L, product_id=_L, product_count=_L, sell_price=_M),
    "products": _table(id=_L, name=_S, unit=_S),
    "finance_logs": _table(log_key=_L, type=_S, count=_M, time=_L, use_id=_L, factory=_S),
    "finance_output": _table(id=_L, time=_L, creator_id=_S),
    "purchase": _table(
        id=_L, material_type_id=_L, material_count=_L, total_price=_M, buyer=_S, buy_time=_L, putin_time=_L,
        time=_L, creator=_S, factory=_S,
    ),
    "material_types": _table(id=_L, name=_S),
    "product_task": _table(
        id=_L, factory=_S, product_id=_L, complete_count=_L, start_time=_L, complete_time=_L, creator=_S, time=_L
    ),
    "material_incoming": _MATERIAL_MOVE,
    "material_outgoing": _MATERIAL_MOVE,
    "product_incoming": _PRODUCT_MOVE,
    "product_outgoing": _PRODUCT_MOVE,
    "materials_log": _table(use_id=_L, time=_L),
    "products_log": _table(use_id=_L, time=_L),
    "xd_learn_task": _table(id=_L, title=_S, descr=_S, keyword_ids=_A, images=_A, state=_S, time=_L),
    "xd_image_keyword": _table(id=_L, keyword=_S, image=_S, level=_I, parent=_S, time=_L),
    "user_xd_image_tag": _table(
        id=_L, phone=_S, keyword_id=_L, image=_S, time=_L, state=_S, err_reason=_S
    ),
    "industry_plus_factorys": _table(
        phone=_S, company_name=_S, industry=_S, region=_S, contact_name=_S, contact_phone=_S, problems=_S,
        supplement=_A, time=_L,
    ),
    "industry_plus_test": _table(phone=_S, company_name=_S, intelligent_degree=_A, score=_D, time=_L),
    "bg_banner": _table(id=_S, image=_S, state=_S, time=_L),
    "bg_user": _table(username=_S, phone=_S, name=_S, rights=_S, time=_L),
}

# Tables whose key the data model declares unique; joining one of them on it never multiplies rows.
UNIQUE_KEYS: dict[str, str] = {
    "user_info": "phone",
    "factorys": "id",
    "factory_clients": "id",
    "products": "id",
    "material_types": "id",
    "xd_image_keyword": "id",
    "tp_apps": "id",
    "bg_banner": "id",
    "bg_user": "phone",
}
