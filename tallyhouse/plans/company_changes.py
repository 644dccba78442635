"""Changing companies in a batch.

A request sets a company's data and makes one phone its only administrator. It is refused while that phone is the only
administrator of two companies or more, or has two memberships or more, so acceptance depends on earlier requests.

What follows from the rules, per phone:

* memberships only ever grow, by at most one per company. With two at the start, everything is refused. Otherwise every
  accepted request is for the phone's *home* (its one company, or the first accepted one), and the first accepted
  request elsewhere is the last one accepted: the phone's *end*;
* the administrator count can only reach two if the phone administers a company other than its home. For all other
  phones the outcome is therefore known from the first request off the home, in one pass and without looking at
  anybody else's requests;
* the remaining phones, the *bound* ones, lose companies off their home, each when somebody else is first accepted there
  (the company is *taken*), and never win one back before their end. With two or more left everything is refused; with
  one, a request is accepted unless the phone leads its home; with none it is accepted. With one or none left a request
  for the home leaves the phone leading it, accepted or not, so who leads a company follows without knowing which of these
  requests were accepted.

So all outcomes follow from two moments: the end of each bound phone and when each company is taken. They are computed in
passes over all bound requests, each from the moments of the pass before, until none changes. What a moment depends on is
earlier, so moments that reproduce themselves are the right ones. Passes are as many as moments depend on one another in a
chain, however many requests there are and however often phones take turns at a company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.functions.predicates import given, is_phone
from tallyhouse.functions.values import blank, message, uploaded_id, uploads
from tallyhouse.operators.asof import around, dealt
from tallyhouse.operators.changes import (
    accepted,
    append,
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


def _one_pass(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Requests (o, f, x) with ``ok``: True / False where it follows from the phone alone, NULL where others' requests matter.

    ``held`` has the companies (f) that a phone (x) is a member of or ``leads``, administers alone, at the start.
    """
    c = F.col
    known = asked.unionByName(held, allowMissingColumns=True)
    phones = known.groupBy("x").agg(
        F.count_if(~c("leads")).alias("m0"), F.min(F.when(~c("leads"), c("f"))).alias("old_home"),
        F.count_if(c("leads")).alias("a0"), F.min(F.when(c("leads"), c("f"))).alias("led"),
        F.min_by("f", "o").alias("first_f"), F.min("o").alias("first"),
    )
    phones = phones.select("x", "m0", "old_home", "a0", "led", "first", F.coalesce("old_home", "first_f").alias("home"))
    seen = asked.join(phones, "x").groupBy(*phones.columns).agg(
        F.min(F.when(c("f") != c("home"), c("o"))).alias("away"),
        F.count(F.lit(1)).alias("n"), F.count_if(c("o") == c("first")).alias("n_first"),
    )
    # Up to the first request off the home there is only one, asked of phones that administer one company.
    tried_once = F.when(c("away").isNull(), c("n") == 1).otherwise((c("away") == c("first")) & (c("n_first") == 1))
    settled_alone = (c("a0") == 0) | ((c("a0") == 1) & ((c("led") == c("home")) | tried_once))
    return asked.join(seen, "x").select(
        "o", "f", "x", "m0", "old_home",
        F.when(c("m0") >= 2, False).when(settled_alone, c("away").isNull() | (c("o") <= c("away"))).alias("ok"),
    )


def _known(led: DataFrame, taken: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each bound phone: what it had at the start, ``kept`` (the led companies that it keeps longest) and its ``end``."""
    c = F.col
    # Two companies decide, and its home may be one more of them.
    longest = Window.partitionBy("px").orderBy(F.desc_nulls_first("taken"), "g")
    kept = (
        led.join(taken, c("g") == c("tg"), "left").withColumn("_n", F.row_number().over(longest)).where("_n <= 3")
        .groupBy("px", "m0", "old_home").agg(F.array_sort(F.collect_list(F.struct("_n", "g", "taken"))).alias("kept"))
    )
    return kept.join(ends, c("px") == c("ex"), "left").drop("ex")


def _placed(bound: DataFrame, led: DataFrame, known: DataFrame) -> DataFrame:
    """The bound requests (o, f, x) that may be accepted by what is ``known`` of their phones.

    With the phone's home and ``at_home``, whether they are for it; ``free``: none of the phone's companies off its home is
    left (one at most is); ``led_home``: it administers its home at the start. After the phone's end nothing at home counts.
    """
    c = F.col

    def gone(companies: Column, left: int) -> Column:
        """At most ``left`` of the companies are still held just before the request."""
        return (F.size(companies) <= left) | F.coalesce(c("o") > F.get(companies, F.lit(left))["taken"], F.lit(False))

    # Without a membership the first request that meets at most one company makes the home.
    joins = bound.where("m0 = 0").join(known, c("x") == c("px")).where(gone(c("kept"), 1))
    begins = joins.groupBy(c("x").alias("bx")).agg(F.min(F.struct("o", "f")).alias("begin"))
    settled = known.join(begins, c("px") == c("bx"), "left").select(
        "px", "kept", "end", "begin.o", F.when(c("m0") == 0, c("begin.f")).otherwise(c("old_home")).alias("home")
    ).withColumnRenamed("o", "begin")
    off_home = F.filter("kept", lambda company: ~F.coalesce(company["g"] == c("home"), F.lit(False)))
    facts = (
        settled.withColumn("off_home", off_home)
        .join(led.select(c("px").alias("hx"), c("g").alias("hg")), (c("px") == c("hx")) & (c("home") == c("hg")), "left")
        .select("px", "begin", "home", "off_home", c("hx").isNotNull().alias("led_home"), "end")
    )
    begun = (c("m0") > 0) | F.coalesce(c("o") >= c("begin"), F.lit(False))
    at_home = F.coalesce(c("f") == c("home"), F.lit(False))
    return bound.join(facts, c("x") == c("px")).where(begun & gone(c("off_home"), 1)).select(
        "o", "f", "x", "home", "led_home", "end", gone(c("off_home"), 0).alias("free"), at_home.alias("at_home"),
    ).where(~c("at_home") | c("end").isNull() | (c("o") < c("end.o"))).drop("end")


def _leads(placed: DataFrame, alone: DataFrame, known: DataFrame, ranges: int) -> DataFrame:
    """``placed`` with ``leads``: the phone leads its home just before."""
    c = F.col
    ends = known.where(c("end").isNotNull()).select(c("end.f").alias("home"), "end.o", c("px").alias("x"))
    sets = alone.select(c("at").alias("home"), "o", "x").unionByName(ends)
    found = around(placed, sets, "home", "o", "x", None, False, ranges, "at_home")
    leads = F.when(c("before").isNull(), c("led_home")).otherwise(c("before.who") == c("x"))
    return found.withColumn("leads", leads).drop("before")


def _decide(requests: DataFrame, held: DataFrame) -> DataFrame:
    """(o, ok) of every request (o, f, x)."""
    c = F.col
    first = written(dealt(_one_pass(requests, held), "o"))
    bound = first.where(c("ok").isNull()).select("o", "f", "x", "m0", "old_home")
    phones = bound.groupBy(c("x").alias("px")).agg(F.first("m0").alias("m0"), F.first("old_home").alias("old_home"))
    # A phone that leads nothing is never bound, so every bound phone is here.
    led = written(
        held.where("leads").select(c("x").alias("lx"), c("f").alias("g")).distinct()
        .join(phones, c("lx") == c("px")).drop("lx")
    )
    if led.isEmpty():
        return first.select(c("o.place").alias("o"), "ok")
    ranges = first.agg(F.max("o.part")).first()[0] + 1
    # Of the other phones: when they first take a company that a bound phone leads (without x), and all that they take of
    # those that a bound phone may have as its home.
    homes = bound.select(c("f").alias("home")).unionByName(led.select(c("old_home").alias("home"))).distinct()
    alone = first.where("ok").select(c("f").alias("at"), "o", "x")
    by_alone = alone.groupBy("at").agg(F.min("o").alias("o")).join(led, c("at") == c("g"), "left_semi")
    alone = written(
        alone.join(homes, c("at") == c("home"), "left_semi").unionByName(by_alone, allowMissingColumns=True)
    )
    by_alone = alone.where(c("x").isNull()).select(c("at").alias("tg"), c("o").alias("taken"))
    set_alone = alone.where(c("x").isNotNull())
    no_ends = bound.select(c("x").alias("ex"), F.struct("o", "f").alias("end")).where(F.lit(False))
    known = written(_known(led, by_alone, no_ends))
    ended = ~c("at_home") & (c("free") | c("home").isNull() | ~c("leads"))
    while True:
        placed = written(_leads(_placed(bound, led, known), set_alone, known, ranges))
        ends = placed.where(ended).groupBy(c("x").alias("ex")).agg(F.min(F.struct("o", "f")).alias("end"))
        # A request for a home led from the start, with one more company left, is refused while nobody else had it.
        genuine = placed.where(c("at_home") & (c("free") | ~c("led_home")))
        events = (
            genuine.select(c("f").alias("tg"), c("o").alias("taken"))
            .unionByName(ends.select(c("end.f").alias("tg"), c("end.o").alias("taken"))).unionByName(by_alone)
        )
        taken = events.groupBy("tg").agg(F.min("taken").alias("taken"))
        was = known.select(c("px").alias("was"), c("kept").alias("was_kept"), c("end").alias("was_end"))
        same = c("kept").eqNullSafe(c("was_kept")) & c("end").eqNullSafe(c("was_end"))
        known = written(
            _known(led, taken, ends).join(was, c("px") == c("was")).withColumn("same", same).drop(*was.columns)
        )
        if known.where(~c("same")).isEmpty():
            break
        known = known.drop("same")

    # The last pass saw the moments as they are.
    won = (
        placed.where(c("at_home") & (c("free") | ~c("leads"))).select("o", "f", "x")
        .unionByName(known.where(c("end").isNotNull()).select("end.o", "end.f", c("px").alias("x"))).distinct()
    )
    won = won.select(c("o").alias("wo"), c("f").alias("wf"), c("x").alias("wx"))
    outcome = bound.join(won, (c("o") == c("wo")) & (c("f") == c("wf")) & (c("x") == c("wx")), "left").select(
        c("o.place").alias("o"), c("wo").isNotNull().alias("ok")
    )
    return first.where(c("ok").isNotNull()).select(c("o.place").alias("o"), "ok").unionByName(outcome)


def _file_id(column: str) -> Column:
    """An 18-character value is an id that stays, anything else an upload."""
    value = F.col(column)
    upload = uploaded_id(value, f"modify_companies.{column}", F.col("req_id"))
    return F.when(~given(value), "").when(F.length(value) == 18, value).otherwise(upload)


def modify_companies(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, factory_id, company_name, contact, administrators, company_area, company_category, auth_file,
    business_licence, req_time). A former administrator keeps the membership."""
    c = F.col
    factorys, factory_users = t["factorys"], t["factory_users"]
    known = count_matches(requests, "factory_id", factorys, "id", "_rows")
    standing = written(
        judged(
            known.withColumn("_order", request_order()),
            ("missing company id", ~given(c("factory_id"))),
            ("bad phone", ~is_phone(c("administrators"))),
            ("unknown company", c("_rows") == 0),
        )
    )
    asked = standing.where(c("reason").isNull()).select(
        c("_order").alias("o"), c("factory_id").alias("f"), c("administrators").alias("x")
    )
    members = factory_users.select(c("phone").alias("x"), c("factory").alias("f"), F.lit(False).alias("leads"))
    sole = factorys.where(F.size("administrators") == 1).select(
        c("administrators")[0].alias("x"), c("id").alias("f"), F.lit(True).alias("leads")
    )
    held = written(cut_to(members.unionByName(sole), "x", asked, "x"))
    decided = _decide(asked, held)
    checked = written(
        standing.join(decided, standing["_order"] == decided["o"], "left").withColumn(
            "reason", F.coalesce("reason", F.when(~c("ok"), "phone belongs to other companies"))
        )
    )
    ok = accepted(checked).select(*requests.columns)

    company = latest(ok, ["factory_id"], request_order(), "contact", "company_name", "administrators", "req_time")
    pair = latest(ok, ["factory_id", "administrators"], request_order(), "contact", "req_time")
    form = latest(
        ok.select("*", _file_id("auth_file").alias("image1"), _file_id("business_licence").alias("image2")),
        ["administrators"], request_order(),
        "company_name", "company_category", "company_area", "contact", "image1", "image2", "req_time",
    )
    # Several users may carry the contact's name; the smallest phone stands for them.
    named = cut_to(t["user_info"].select("phone", c("name").alias("user_name")), "user_name", form, "contact")
    phones = named.groupBy("user_name").agg(F.min("phone").alias("contact_phone"))
    form = form.join(phones, c("contact") == c("user_name"), "left").withColumn(
        "contact_phone", F.coalesce("contact_phone", "administrators")
    )
    rows = pair.select(
        c("administrators").alias("phone"), c("contact").alias("name"), F.array(F.lit("1")).alias("rights"),
        c("factory_id").alias("factory"), c("req_time").alias("time"),
    )

    def ch(name: str) -> Column:
        return c(f"change.{name}")

    return JobResult(
        "modify_companies", requests, ok, rejected(checked),
        uploads=uploads(
            ok.select(
                "req_id",
                *[F.when(F.length(x) != 18, c(x)).alias(x) for x in ("auth_file", "business_licence")],
            ),
            one={x: f"modify_companies.{x}" for x in ("auth_file", "business_licence")},
        ),
        replaced={
            "factorys": update(
                factorys, company.withColumnRenamed("factory_id", "id"), ["id"],
                {
                    "name": ch("contact"), "title": ch("company_name"),
                    "administrators": F.array(ch("administrators")), "time": ch("req_time"),
                },
            ),
            "factory_users": append(
                delete(factory_users, pair, {"factory": "factory_id", "phone": "administrators"}), rows
            ),
            "bg_examine": update(
                t["bg_examine"], form.withColumn("id", c("administrators")), ["id"],
                {
                    "name": ch("company_name"), "industry": blank(ch("company_category")),
                    "region": blank(ch("company_area")), "contact": ch("contact_phone"),
                    "image1": ch("image1"), "image2": ch("image2"), "time": ch("req_time"),
                },
            ),
        },
        messages=ok.select(
            "req_id",
            message(
                "BgFacsModify", "POST", id=c("factory_id"), name=c("contact"), title=c("company_name"),
                administrators=c("administrators"),
            ).alias("value"),
        ),
    )
