"""Optional filters. A filter that is not asked for is ``None`` and simply drops out."""

from __future__ import annotations

import re
from collections.abc import Iterable
from decimal import Decimal
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.constants import PHONE_PATTERN


def like_pattern(text: str) -> str:
    """``%text%`` with the user's own ``%`` and ``_`` kept as wildcards.

    A backslash in front of an ordinary character means that character, which Spark would refuse.
    """
    def plain(match: re.Match[str]) -> str:
        return match[0] if match[1] in "%_\\" else match[1]

    return re.sub(r"\\(.)", plain, f"%{text}%", flags=re.DOTALL)


def contains(column: Column, text: str | None, always: bool = False) -> Column | None:
    """Substring match. With ``always`` an empty text still removes NULLs, as ``like '%%'`` does."""
    if not text:
        return column.isNotNull() if always else None
    return column.like(like_pattern(text))


def equals(column: Column, value: Any) -> Column | None:
    return None if value is None or value == "" else column == F.lit(value)


def closed_range(column: Column, low: Any = None, high: Any = None) -> Column | None:
    return all_of(
        None if low is None or low == "" else column >= F.lit(exact(low)),
        None if high is None or high == "" else column <= F.lit(exact(high)),
    )


def exact(limit: Any) -> Any:
    """A float limit as the decimal it is written as, so that it meets money columns without making doubles of them."""
    return Decimal(str(limit)) if isinstance(limit, float) else limit


def all_of(*conditions: Column | None) -> Column | None:
    present = [c for c in conditions if c is not None]
    return reduce(and_, present) if present else None


def keep(df: DataFrame, *conditions: Column | None) -> DataFrame:
    condition = all_of(*conditions)
    return df if condition is None else df.where(condition)


def given(column: Column) -> Column:
    """True for a text or list parameter that is present and not empty."""
    return F.coalesce(column != F.lit(""), F.lit(False))


def given_list(column: Column) -> Column:
    return F.coalesce(F.size(column) > 0, F.lit(False))


def is_phone(column: Column) -> Column:
    return F.coalesce(column.rlike(PHONE_PATTERN), F.lit(False))


def one_of(column: Column, values: Iterable[str]) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))
