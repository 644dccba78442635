"""The tables that reports look things up in, columns prefixed so that joins never clash."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.predicates import keep
from tallyhouse.operators.listing import Lookup

Tables = Mapping[str, DataFrame]


def picked(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


def user(t: Tables, left_on: str, prefix: str = "user_") -> Lookup:
    right = picked(t["user_info"], prefix, "phone", "name", "image", "auth_state", "time", "invitor_id")
    return Lookup(right, left_on, f"{prefix}phone", unique=True)


def company(t: Tables, left_on: str, prefix: str = "company_") -> Lookup:
    right = picked(t["factorys"], prefix, "id", "name", "title", "administrators")
    return Lookup(right, left_on, f"{prefix}id", unique=True)


def membership(t: Tables, left_on: str, prefix: str = "member_") -> Lookup:
    """People may belong to several companies, so this one multiplies rows."""
    right = picked(keep(t["factory_users"], F.col("phone").isNotNull()), prefix, "phone", "factory")
    return Lookup(right, left_on, f"{prefix}phone", hot=kept_counters(t, "factory_users", "phone"))


def kept_counters(t: Tables, table: str, *keys: str) -> Callable[[int], Mapping[int, int] | None] | None:
    """The hot keys of a table from counters beside it, where ``t`` keeps any."""
    known = getattr(t, "hot_keys", None)
    return known and partial(known, table, keys)


def named(t: Tables, table: str, left_on: str, prefix: str, *columns: str) -> Lookup:
    return Lookup(picked(t[table], prefix, "id", *columns), left_on, f"{prefix}id", unique=True)


def searched(t: Tables, table: str, **texts: str | None) -> DataFrame:
    """A table about to be filtered by substrings of columns: by its postings, where ``t`` keeps any that help, cut first."""
    cut = getattr(t, "cut_by_text", None)
    return cut(table, texts) if cut and any(texts.values()) else t[table]
