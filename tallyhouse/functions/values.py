"""Scalar values: defaults, rounding, image links, ids, uploaded payloads, change messages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.constants import EXPENSE, IMAGE_BASE, INCOME


def blank(column: Column) -> Column:
    """NULL shown as empty text."""
    return F.coalesce(column, F.lit(""))


def zero_as_null(column: Column) -> Column:
    return F.when(column != 0, column)


def as_text(column: Column) -> Column:
    """Image ids kept as bytes, read as UTF-8 text."""
    return F.decode(column, "UTF-8")


def image_url(image_id: Column, base: str = IMAGE_BASE) -> Column:
    return F.when(image_id != "", F.concat(F.lit(base), image_id, F.lit(".jpg"))).otherwise("")


def image_urls(image_ids: Column, base: str = IMAGE_BASE) -> Column:
    return F.transform(image_ids, lambda i: image_url(i, base))


def money(column: Column) -> Column:
    """Two decimals, ties to even."""
    return F.bround(column, 2)


def percent(part: Column, whole: Column) -> Column:
    share = F.try_divide(part.cast("decimal(20,0)") * 100, whole.cast("decimal(20,0)"))
    return F.coalesce(F.bround(share, 2), F.lit(0)).cast("decimal(18,2)")


def flow_label(amount: Column) -> Column:
    return F.when(amount >= 0, INCOME).when(amount < 0, EXPENSE)


def short_id(job: str, *parts: Column) -> Column:
    """18-character id that is the same on every retry of a request."""
    text = F.concat_ws("|", F.lit(job), *[p.cast("string") for p in parts])
    return F.substring(F.sha2(text, 256), 1, 18)


def number_id(job: str, *parts: Column) -> Column:
    """The same for tables with numeric ids: the first 60 bits of the digest."""
    text = F.concat_ws("|", F.lit(job), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def payload_bytes(payload: Column) -> Column:
    """Bytes of an uploaded data URI: base64 after the last comma; NULL when it does not decode or is empty.

    Characters outside the base64 alphabet are skipped and anything after the padding is ignored.
    """
    raw = F.substring_index(payload, ",", -1)
    # Line ends are the usual strangers; with them gone most texts pass one possessive match and need no rewriting.
    lines = F.replace(F.replace(raw, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    strange = F.regexp_replace(lines, "[^A-Za-z0-9+/=]", "")
    tail = F.when(lines.rlike("^[A-Za-z0-9+/=]*+$"), lines).otherwise(strange)
    body = F.substring_index(tail, "=", 1)
    pad = F.substr(tail, F.length(body) + 1)
    over = F.length(body) % 4
    # Two or three characters over need their padding, none over may have any; one over is never complete.
    whole = (
        F.when((over == 0) & (F.replace(pad, F.lit("="), F.lit("")) == ""), body)
        .when((over == 2) & pad.startswith("=="), F.concat(body, F.lit("==")))
        .when((over == 3) & pad.startswith("="), F.concat(body, F.lit("=")))
    )
    return F.when(payload.contains(",") & (whole != ""), F.try_to_binary(whole, F.lit("base64")))


def uploaded_id(payload: Column, job: str, *parts: Column) -> Column:
    """Image id a payload is stored under, NULL when there is nothing to store."""
    return F.when(payload_bytes(payload).isNotNull(), short_id(job, *parts))


def uploaded_ids(payloads: Column, job: str, *parts: Column) -> Column:
    """Ids of the decodable payloads of a list, in list order."""
    ids = F.transform(payloads, lambda p, i: uploaded_id(p, job, *parts, i))
    return F.filter(ids, lambda x: x.isNotNull())


def uploads(rows: DataFrame, one: Mapping[str, str] | None = None, many: Mapping[str, str] | None = None) -> DataFrame:
    """(image_id, content, size) of what the payloads in ``rows`` store, under the ids the rows get from them.

    ``one`` names payload columns and ``many`` list columns, each with the job part of its ids; requests are told apart by
    ``req_id`` as there. Payloads that do not decode store nothing.
    """
    found = [
        rows.select(short_id(job, F.col("req_id")).alias("image_id"), payload_bytes(F.col(name)).alias("content"))
        for name, job in (one or {}).items()
    ]
    for name, job in (many or {}).items():
        items = rows.select("req_id", F.posexplode(name).alias("_at", "_payload"))
        found.append(
            items.select(
                short_id(job, F.col("req_id"), F.col("_at")).alias("image_id"), payload_bytes(F.col("_payload")).alias("content")
            )
        )
    stored = reduce(DataFrame.unionByName, found).where(F.col("content").isNotNull())
    return stored.withColumn("size", F.octet_length("content").cast("bigint"))


def message(resource: str, kind: str, **params: Column) -> Column:
    """One change message as JSON text."""
    body = F.struct(*[value.alias(name) for name, value in params.items()])
    envelope = F.struct(F.lit(resource).alias("resource"), F.lit(kind).alias("type"), body.alias("params"))
    return F.to_json(envelope, {"ignoreNullFields": "false"})
