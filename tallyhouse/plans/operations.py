"""Reports about apps, orders, money, purchases, production and stock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.constants import IMAGE_BASE, MATERIAL, PRODUCT, STOCK_IN, STOCK_OUT
from tallyhouse.functions.arrays import zip_shortest
from tallyhouse.functions.predicates import contains, equals, keep
from tallyhouse.functions.values import blank, flow_label, image_url, image_urls, money
from tallyhouse.operators.listing import ListReport, Lookup
from tallyhouse.operators.paging import newest_first, row_total
from tallyhouse.plans.lookups import Tables, company, membership, named, picked, user


def apps(t: Tables, id: str | None = None, name: str = "", image_base: str = IMAGE_BASE) -> ListReport:
    """Third-party apps by name, descending."""
    c = F.col
    return ListReport(
        base=keep(t["tp_apps"], equals(c("id"), id), contains(c("name"), name)),
        order=newest_first("name", "id"),
        output=[
            c("id"), c("name"), c("slogan"), c("dsd_val"), c("url"),
            image_url(c("icon"), image_base).alias("icon"),
            c("descs"),
            image_urls(c("images"), image_base).alias("images"),
            c("state"), c("time"),
        ],
    )


def _order_sums(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("order_id").alias("sum_order_id")).agg(F.sum("sell_price").alias("sales_sum"))


def order_sales(t: Tables, id: str = "", name: str = "", company_name: str = "") -> ListReport:
    """Orders with their client, creator, company and the plain sum of their line prices."""
    c = F.col
    lines = t["order_products"].select("order_id", "sell_price")
    return ListReport(
        base=keep(t["orders"], contains(c("creator"), id)),
        lookups=[
            named(t, "factory_clients", "client_id", "customer_", "name"),
            user(t, "creator"),
            Lookup(
                _order_sums(lines), "id", "sum_order_id", unique=True,
                build=_order_sums, source=lines, source_on="order_id",
            ),
            company(t, "factory"),
        ],
        tests=[
            ("user_name", contains(c("user_name"), name)), ("company_name", contains(c("company_name"), company_name)),
        ],
        order=newest_first("time", "id"),
        output=[
            c("id").alias("order_id"),
            c("customer_name").alias("client"),
            c("user_name").alias("creator"),
            money(c("sales_sum")).cast("decimal(28,2)").alias("sales"),
            c("company_name").alias("company"),
            c("time"),
        ],
    )


LINE_FIELDS = ("product_name", "product_count", "product_unit")


def order_lines(t: Tables, orders: DataFrame) -> DataFrame:
    """The product lines of ``orders`` (any frame with ``order_id``) as flat rows.

    Flat on purpose: one order may hold any share of all lines. A page's size is known from its limit, so Spark
    broadcasts its ids by itself and leaves the lines where they are.
    """
    ids = orders.select(F.col("order_id").alias("_wanted")).distinct()
    source = t["order_products"].select("order_id", "product_id", "product_count")
    lines = source.join(ids, source["order_id"] == ids["_wanted"], "left_semi")
    products = picked(t["products"], "product_", "id", "name", "unit").withColumnRenamed("product_id", "_product")
    return lines.join(products, lines["product_id"] == products["_product"], "left").select(
        "order_id", "product_name", "product_count", "product_unit"
    )


def _all_money_events(t: Tables) -> DataFrame:
    out = t["finance_output"].select("id", "time", F.col("creator_id").alias("creator"))
    orders = t["orders"].select("id", F.col("deliver_time").alias("time"), "creator")
    bought = t["purchase"].select("id", F.col("buy_time").alias("time"), "creator")
    return out.unionByName(orders).unionByName(bought)


def money_events(t: Tables) -> DataFrame:
    """Payments out, deliveries and purchases as one set of (id, time, creator); ids of the three may coincide."""
    return _all_money_events(t).distinct()


def _event_side(events: DataFrame) -> DataFrame:
    return picked(events, "event_", "id", "time", "creator")


def finance_flow(t: Tables, id: str = "", name: str = "", company_name: str = "") -> ListReport:
    """Income and expense with the event each entry refers to; several events of one id give several rows."""
    c = F.col
    events = money_events(t)
    return ListReport(
        base=t["finance_logs"],
        lookups=[
            Lookup(
                _event_side(events), "use_id", "event_id", distinct=True, counted=_event_side(_all_money_events(t)),
            ),
            user(t, "event_creator"),
            company(t, "factory"),
        ],
        tests=[
            ("user_phone", contains(c("user_phone"), id)), ("user_name", contains(c("user_name"), name)),
            ("company_name", contains(c("company_name"), company_name)),
        ],
        base_order=newest_first("time", "log_key"),
        order=newest_first("time", "log_key", "event_time", "event_creator"),
        output=[
            c("type").alias("category"),
            money(F.abs("count")).cast("decimal(18,2)").alias("sales"),
            c("time").alias("use_time"),
            c("event_time").alias("create_time"),
            c("user_name").alias("creator"),
            c("company_name").alias("company"),
            flow_label(c("count")).alias("input_output"),
        ],
    )


def purchases(t: Tables, id: str = "", name: str = "", company_name: str = "") -> ListReport:
    """Purchases; one row per membership of the creator and per user who carries the buyer's name."""
    c = F.col
    buyers = picked(t["user_info"], "buyer_", "name", "phone")
    sales = money(c("total_price"))
    return ListReport(
        base=keep(t["purchase"], contains(c("buyer"), name)),
        lookups=[
            named(t, "material_types", "material_type_id", "material_", "name"),
            company(t, "factory"),
            membership(t, "creator"),
            Lookup(buyers.where(c("buyer_name").isNotNull()), "buyer", "buyer_name"),
        ],
        tests=[
            ("buyer_phone", contains(c("buyer_phone"), id)), ("company_name", contains(c("company_name"), company_name)),
        ],
        order=newest_first("time", "id"),
        output=[
            c("material_count").alias("num"),
            sales.cast("decimal(18,2)").alias("sales"),
            c("buyer"), c("buy_time"), c("putin_time"),
            c("time").alias("create_time"),
            c("material_name").alias("product"),
            c("company_name").alias("company"),
            F.try_divide(sales.cast("double"), c("material_count").cast("double")).alias("price"),
        ],
    )


def production(t: Tables, id: str = "", name: str = "", company_name: str = "") -> ListReport:
    c = F.col
    return ListReport(
        base=t["product_task"],
        lookups=[
            named(t, "products", "product_id", "made_", "name"), company(t, "factory"), user(t, "creator"),
        ],
        tests=[
            ("user_phone", contains(c("user_phone"), id)), ("user_name", contains(c("user_name"), name)),
            ("company_title", contains(c("company_title"), company_name)),
        ],
        order=newest_first("time", "id"),
        output=[
            c("made_name").alias("product"),
            c("complete_count").alias("num"),
            c("start_time"),
            c("complete_time").alias("finished_time"),
            c("user_name").alias("recorder"),
            c("company_title").alias("company"),
            c("time").alias("create_time"),
        ],
    )


def production_shown_total(t: Tables) -> DataFrame:
    """The total shown beside the production list: it ignores every filter."""
    return production(t).total()


# The four branches of the stock ledger, in their fixed order:
# movement table, item list column, log table, category, direction.
STOCK_BRANCHES = (
    ("material_incoming", "materials", "materials_log", MATERIAL, STOCK_IN),
    ("material_outgoing", "materials", "materials_log", MATERIAL, STOCK_OUT),
    ("product_incoming", "products", "products_log", PRODUCT, STOCK_IN),
    ("product_outgoing", "products", "products_log", PRODUCT, STOCK_OUT),
)


def _movements(t: Tables) -> DataFrame:
    """The four branches as one table, numbered in their fixed order."""
    branches = [
        t[table].select(
            F.lit(number).alias("branch"), F.lit(log).alias("log_table"), F.lit(category).alias("category"),
            F.lit(inout).alias("inout"), "id", "factory", F.col(items).alias("items"), "counts", "time", "creator_id",
        )
        for number, (table, items, log, category, inout) in enumerate(STOCK_BRANCHES)
    ]
    return reduce(DataFrame.unionByName, branches)


def _movement_logs(t: Tables) -> DataFrame:
    logs = [
        t[log].select(F.lit(log).alias("log_name"), F.col("use_id").alias("log_use_id"), F.col("time").alias("log_time"))
        for log in ("materials_log", "products_log")
    ]
    return reduce(DataFrame.unionByName, logs)


def stock_ledger(t: Tables, id: str = "", name: str = "", company_name: str = "") -> ListReport:
    """Material and product movements: four branches one after the other, each newest first, ``rn`` running through.

    ``pairs`` holds (item id, number); movements without a usable item list show no items at all, so it is NULL there.
    """
    c = F.col
    usable = (F.size("items") > 0) & (F.size("counts") > 0)
    return ListReport(
        base=_movements(t),
        lookups=[
            user(t, "creator_id"), company(t, "factory"),
            Lookup(_movement_logs(t), ("log_table", "id"), ("log_name", "log_use_id")),
        ],
        tests=[
            ("user_phone", contains(c("user_phone"), id)), ("user_name", contains(c("user_name"), name)),
            ("company_title", contains(c("company_title"), company_name)),
        ],
        base_order=newest_first("time", "id", lead=("branch",)),
        order=newest_first("time", "id", "log_time", lead=("branch",)),
        output=[
            c("id"), c("category"), c("inout"),
            F.coalesce("log_time", F.lit(0)).alias("time"),
            blank(c("user_name")).alias("recorder"),
            blank(c("company_title")).alias("company"),
            F.coalesce("time", F.lit(0)).alias("create_time"),
            F.when(usable, zip_shortest(c("items"), c("counts"), "item", "number")).alias("pairs"),
        ],
    )


def stock_shown_total(t: Tables) -> DataFrame:
    """The total shown beside the stock ledger: it ignores every filter."""
    return stock_ledger(t).total()


def stock_items(t: Tables, movements: DataFrame, few: bool = False) -> DataFrame:
    """The items of ``movements`` as flat rows with their names, '' for unknown ones.

    Keeps every column of ``movements`` but the pairs. With ``few``, as for a page, the names are first cut to those
    asked for.
    """
    kept = [col for col in movements.columns if col != "pairs"]
    flat = movements.select(*kept, F.posexplode("pairs").alias("pos", "pair")).select(
        *kept, "pos",
        F.when(F.col("category") == MATERIAL, "m").otherwise("p").alias("_kind"),
        F.col("pair.item").alias("_item"),
        F.col("pair.number").alias("number"),
    )
    names = reduce(
        DataFrame.unionByName,
        [
            t[table].select(
                F.lit(kind).alias("_name_kind"), F.col("id").cast("string").alias("_name_id"), F.col("name").alias("_name")
            )
            for kind, table in (("m", "material_types"), ("p", "products"))
        ],
    )
    if few:
        asked = flat.select(F.col("_kind").alias("_k"), F.col("_item").alias("_i")).distinct()
        names = names.join(
            asked, (names["_name_kind"] == asked["_k"]) & (names["_name_id"] == asked["_i"]), "left_semi"
        )
    matched = flat.join(
        names, (flat["_kind"] == names["_name_kind"]) & (flat["_item"] == names["_name_id"]), "left"
    )
    return matched.select(*kept, "pos", blank(F.col("_name")).alias("name"), "number")


def learn_tasks(t: Tables, image_base: str = IMAGE_BASE) -> DataFrame:
    """Learning tasks with the keywords of their ids in list order; unknown keywords stay as NULLs, no ids give NULL.

    A group is one task's own id list, so it is as small as the row it came from.
    """
    tasks = t["xd_learn_task"]
    ids = tasks.select(F.col("id").alias("task_id"), F.posexplode("keyword_ids").alias("pos", "keyword_id"))
    words = t["xd_image_keyword"].select(F.col("id").cast("string").alias("word_id"), "keyword")
    tagged = ids.join(words, ids["keyword_id"] == words["word_id"], "left")
    tags = tagged.groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda x: x["keyword"]).alias("tags")
    )
    return (
        tasks.join(tags, tasks["id"] == tags["task_id"], "left")
        .select(
            "id", "title", "descr", "tags", image_urls(F.col("images"), image_base).alias("images"), "state", "time"
        )
        .orderBy("id")
    )


def learn_task_total(t: Tables) -> DataFrame:
    return row_total(t["xd_learn_task"])


def tag_keywords(t: Tables, level: int = 1) -> DataFrame:
    return t["xd_image_keyword"].where(F.col("level") == level).select(
        F.col("id").alias("key"), F.col("keyword").alias("value")
    )


def image_tags(
    t: Tables, phone: str = "", name: str = "", state: str = "", keyword: int | None = None,
    image_base: str = IMAGE_BASE,
) -> ListReport:
    """Tagged images of known, named users."""
    c = F.col
    return ListReport(
        base=keep(
            t["user_xd_image_tag"],
            contains(c("phone"), phone), equals(c("state"), state), equals(c("keyword_id"), keyword),
        ),
        lookups=[named(t, "xd_image_keyword", "keyword_id", "word_", "keyword", "image"), user(t, "phone")],
        tests=[("user_name", contains(c("user_name"), name, always=True))],
        order=newest_first("time", "id"),
        output=[
            c("id"), c("phone"),
            c("user_name").alias("name"),
            c("word_keyword").alias("keyword"),
            image_url(c("word_image"), image_base).alias("image1"),
            image_url(c("image"), image_base).alias("image2"),
            c("time"), c("state"), c("err_reason"),
        ],
    )


def banners(t: Tables, image_base: str = IMAGE_BASE) -> ListReport:
    c = F.col
    return ListReport(
        base=t["bg_banner"],
        order=newest_first("time", "id"),
        output=[c("id"), image_url(c("image"), image_base).alias("image"), c("state"), c("time")],
    )
