"""Jobs on apps, learning tasks, keywords, banners and uploaded images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.arrays import distinct_list
from tallyhouse.functions.predicates import given, one_of
from tallyhouse.functions.values import blank, number_id, payload_bytes, short_id, uploaded_id, uploaded_ids, uploads
from tallyhouse.operators.changes import (
    accepted,
    count_matches,
    cut_to,
    delete,
    earliest,
    judged,
    latest,
    rejected,
    update,
)
from tallyhouse.operators.scratch import written
from tallyhouse.plans.jobs import JobResult, request_order
from tallyhouse.plans.lookups import Tables


def add_apps(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, name, icon, slogan, descs, images, dsd_val, url, req_time): icon required, bad screenshots left out."""
    c = F.col
    checked = written(
        judged(
            requests.withColumn("icon_id", uploaded_id(c("icon"), "add_apps.icon", c("req_id"))),
            ("missing icon", ~given(c("icon"))),
            ("bad icon", c("icon_id").isNull()),
            ("missing parameter", c("images").isNull() | c("descs").isNull() | c("dsd_val").isNull()),
        )
    )
    ok = accepted(checked)
    rows = ok.select(
        short_id("add_apps", c("req_id")).alias("id"), blank(c("name")).alias("name"),
        blank(c("slogan")).alias("slogan"), c("dsd_val"), c("url"), c("icon_id").alias("icon"), c("descs"),
        uploaded_ids(c("images"), "add_apps.image", c("req_id")).alias("images"), F.lit("0").alias("state"),
        c("req_time").alias("time"),
    )
    return JobResult(
        "add_apps", requests, ok.select(*requests.columns), rejected(checked), appended={"tp_apps": rows},
        uploads=uploads(ok, one={"icon": "add_apps.icon"}, many={"images": "add_apps.image"}),
    )


def modify_apps(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, name, icon, slogan, descs, images, dsd_val, url, req_time).

    The icon changes only when one is sent; a screenshot entry is a new upload or, when it does not decode, a kept id.
    """
    c = F.col
    checked = written(
        judged(requests, ("missing id", ~given(c("id"))), ("bad value", c("dsd_val").isNull()))
    )
    ok = accepted(checked)
    kept = F.transform(
        F.coalesce("images", F.array().cast("array<string>")),
        lambda p, i: F.when(given(p), F.coalesce(uploaded_id(p, "modify_apps.image", F.col("req_id"), i), p)),
    )
    prepared = ok.select(
        "req_id", "req_time", "id", "name", "slogan", "dsd_val", "url",
        F.coalesce("descs", F.array().cast("array<string>")).alias("descs"),
        F.filter(kept, lambda x: x.isNotNull()).alias("images"),
        uploaded_id(c("icon"), "modify_apps.icon", c("req_id")).alias("icon"),
    )
    fields = ("name", "slogan", "dsd_val", "url", "descs", "images")
    last = prepared.groupBy("id").agg(
        F.max_by(F.struct(*fields), request_order()).alias("set"),
        F.max_by("icon", F.when(c("icon").isNotNull(), request_order())).alias("icon"),
    )
    values = {f: c(f"change.set.{f}") for f in fields}
    values["icon"] = F.coalesce(c("change.icon"), c("icon"))
    return JobResult(
        "modify_apps", requests, ok, rejected(checked),
        replaced={"tp_apps": update(t["tp_apps"], last, ["id"], values)},
        uploads=uploads(ok, one={"icon": "modify_apps.icon"}, many={"images": "modify_apps.image"}),
    )


def _set_state(name: str, table: str, t: Tables, requests: DataFrame) -> JobResult:
    c = F.col
    known = count_matches(requests, "id", t[table], "id", "_rows")
    checked = written(
        judged(
            known,
            ("missing id", ~given(c("id").cast("string"))),
            ("missing state", ~given(c("state"))),
            ("bad state", ~one_of(c("state"), ("0", "1"))),
            ("unknown id", c("_rows") == 0),
        )
    )
    ok = accepted(checked)
    last = latest(ok, ["id"], request_order(), "state")
    return JobResult(
        name, requests, ok.select(*requests.columns), rejected(checked),
        replaced={table: update(t[table], last, ["id"], {"state": c("change.state")})},
    )


def set_app_states(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, state, req_time): 0 hides, 1 shows."""
    return _set_state("set_app_states", "tp_apps", t, requests)


def set_learn_task_states(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, state, req_time)."""
    return _set_state("set_learn_task_states", "xd_learn_task", t, requests)


def add_learn_tasks(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, title, descr, keywords, images, req_time): keywords without repeats, bad images left out."""
    c = F.col
    checked = written(judged(requests, ("missing parameter", c("keywords").isNull() | c("images").isNull())))
    ok = accepted(checked)
    rows = ok.select(
        number_id("add_learn_tasks", c("req_id")).alias("id"), blank(c("title")).alias("title"),
        blank(c("descr")).alias("descr"), distinct_list(c("keywords")).alias("keyword_ids"),
        uploaded_ids(c("images"), "add_learn_tasks.image", c("req_id")).alias("images"),
        c("req_time").alias("time"),
    )
    return JobResult(
        "add_learn_tasks", requests, ok, rejected(checked), appended={"xd_learn_task": rows},
        uploads=uploads(ok, many={"images": "add_learn_tasks.image"}),
    )


def add_tag_keywords(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, type, name, image, req_time): type 0 opens a first level, else it names the parent, whose level counts."""
    c = F.col
    wanted = cut_to(t["xd_image_keyword"].select("id", "level"), "id", requests, "type")
    parents = wanted.select(c("id").alias("parent_id"), c("level").alias("parent_level"))
    kind = F.coalesce("type", F.lit(0))
    checked = written(
        judged(
            requests.join(parents, requests["type"] == parents["parent_id"], "left"),
            ("unknown parent", (kind != 0) & c("parent_id").isNull()),
        )
    )
    ok = accepted(checked)
    rows = ok.select(
        number_id("add_tag_keywords", c("req_id")).alias("id"), blank(c("name")).alias("keyword"),
        F.when(given(c("image")), uploaded_id(c("image"), "add_tag_keywords.image", c("req_id")))
        .otherwise("").alias("image"),
        F.when(kind == 0, 1).otherwise(c("parent_level")).cast("int").alias("level"),
        kind.cast("string").alias("parent"), c("req_time").alias("time"),
    )
    return JobResult(
        "add_tag_keywords", requests, ok.select(*requests.columns), rejected(checked),
        appended={"xd_image_keyword": rows},
        uploads=uploads(ok, one={"image": "add_tag_keywords.image"}),
    )


def add_banners(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, image, req_time): shown at once."""
    c = F.col
    checked = written(
        judged(
            requests.withColumn("image_id", uploaded_id(c("image"), "add_banners.image", c("req_id"))),
            ("bad image", c("image_id").isNull()),
        )
    )
    ok = accepted(checked)
    rows = ok.select(
        short_id("add_banners", c("req_id")).alias("id"), c("image_id").alias("image"), F.lit("1").alias("state"),
        c("req_time").alias("time"),
    )
    return JobResult(
        "add_banners", requests, ok.select(*requests.columns), rejected(checked), appended={"bg_banner": rows},
        uploads=uploads(ok, one={"image": "add_banners.image"}),
    )


def modify_banners(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, state, image, req_time): a state wins over an image; an image that is a link changes nothing.

    Every image that gives way is listed in ``discarded``: the stored one and all new ones but the last.
    """
    c = F.col
    known = count_matches(requests, "id", t["bg_banner"], "id", "_rows")
    link = c("image").contains("https://")
    by_image = c("state").isNull() & c("image").isNotNull() & ~link
    checked = written(
        judged(
            known.withColumn("image_id", F.when(by_image, uploaded_id(c("image"), "modify_banners.image", c("req_id")))),
            ("nothing to change", c("state").isNull() & c("image").isNull()),
            ("unknown banner", by_image & (c("_rows") == 0)),
            ("bad image", by_image & c("image_id").isNull()),
        )
    )
    ok = accepted(checked)
    last = ok.groupBy("id").agg(
        F.max_by("state", F.when(c("state").isNotNull(), request_order())).alias("state"),
        F.max_by("image_id", F.when(c("image_id").isNotNull(), request_order())).alias("image"),
    )
    new = ok.where(c("image_id").isNotNull()).select("id", "image_id")
    final = last.where(c("image").isNotNull()).select(c("id").alias("final_id"), c("image").alias("final_image"))
    passed_over = new.join(final, new["image_id"] == final["final_image"], "left_anti").select(c("image_id").alias("image"))
    stored = t["bg_banner"].join(final, c("id") == c("final_id"), "left_semi").select("image")
    return JobResult(
        "modify_banners", requests, ok.select(*requests.columns), rejected(checked),
        replaced={
            "bg_banner": update(
                t["bg_banner"], last, ["id"],
                {
                    "state": F.coalesce(c("change.state"), c("state")),
                    "image": F.coalesce(c("change.image"), c("image")),
                },
            )
        },
        discarded=stored.unionByName(passed_over),
        uploads=uploads(ok.where(c("image_id").isNotNull()), one={"image": "modify_banners.image"}),
    )


def delete_banners(t: Tables, requests: DataFrame) -> JobResult:
    """(req_id, id, req_time): the first request per banner deletes it, later ones find nothing."""
    c = F.col
    known = count_matches(requests, "id", t["bg_banner"], "id", "_rows")
    first = earliest(requests, ["id"], request_order()).withColumnRenamed("id", "_first_id")
    checked = written(
        judged(
            known.join(first, known["id"] == first["_first_id"], "left"),
            ("unknown banner", (c("_rows") == 0) | (c("_first") < request_order())),
        )
    )
    ok = accepted(checked)
    return JobResult(
        "delete_banners", requests, ok.select(*requests.columns), rejected(checked),
        replaced={"bg_banner": delete(t["bg_banner"], ok, {"id": "id"})},
        discarded=cut_to(t["bg_banner"], "id", ok, "id").select("image"),
    )


def decode_image_payloads(requests: DataFrame, owner: str, payload: str, job: str = "image") -> DataFrame:
    """(owner, image_id, content, size) of uploads; all three are NULL for what does not decode.

    With the ``job`` part of a change job's ids the ids are that job's.
    """
    content = payload_bytes(F.col(payload))
    decoded = requests.select(F.col(owner).alias("owner"), content.alias("content"))
    return decoded.select(
        "owner",
        F.when(F.col("content").isNotNull(), short_id(job, F.col("owner"))).alias("image_id"),
        "content", F.octet_length("content").cast("bigint").alias("size"),
    )


def write_images(images: DataFrame, path: str, environment: str) -> None:
    """Decoded uploads as binary Parquet, one folder per environment."""
    stored = images.where(F.col("image_id").isNotNull()).withColumn("environment", F.lit(environment))
    stored.write.mode("append").partitionBy("environment").parquet(path)
