"""Text lists: joining, pairing, labelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.constants import CAPABILITY_DONE, CAPABILITY_LABELS, CAPABILITY_MISSING, RIGHT_LABELS


def array_text(items: Column) -> Column:
    """Comma-joined text, NULL elements shown as ``*``."""
    return F.array_join(items, ",", "*")


def zip_shortest(left: Column, right: Column, left_name: str, right_name: str) -> Column:
    """Pairs up to the shorter list; NULL when either list is NULL."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(
        F.slice(left, 1, n),
        F.slice(right, 1, n),
        lambda a, b: F.struct(a.alias(left_name), b.alias(right_name)),
    )


def distinct_list(items: Column) -> Column:
    """The list without repeats, in sorted order (the order carries no meaning)."""
    return F.array_sort(F.array_distinct(items))


def _literal_map(labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])


def right_labels(rights: Column) -> Column:
    """Labels of the known one-character codes, in list order; other entries are app ids and drop out."""
    labels = _literal_map(RIGHT_LABELS)
    known = F.filter(rights, lambda r: r.isin(*RIGHT_LABELS))
    return F.transform(known, lambda r: labels[r])


def capability_labels(degrees: Column) -> Column:
    """All five capability labels, each marked as reached or missing."""
    marks = [
        F.concat(
            F.lit(label),
            F.when(F.coalesce(F.array_contains(degrees, code), F.lit(False)), CAPABILITY_DONE).otherwise(
                CAPABILITY_MISSING
            ),
        )
        for code, label in CAPABILITY_LABELS.items()
    ]
    return F.array(*marks)
