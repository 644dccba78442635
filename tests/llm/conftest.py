from __future__ import annotations

import pytest

from tallyhouse.llm.queries import prepared

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int, size string, mark long, row int, toxic string, h int"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepared(spark)


def documents(spark, rows):
    """Rows of (doc_id, text, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, "y", 3) for i, t, s in rows], DOCUMENTS)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two", "b"), (6, "ONE TWO", None),
    (7, "one two three four five six seven", "a"), (7, "one two three four five six seven", "a"),
    (8, "One two three four five six seven", "b"), (None, "one two three four five six seven", "c"), (None, None, None),
    (9, LONG, "c"), (10, LONG + " end", "c"), (11, "é" * 700, "d"), (12, "ab" * 400, "d"), (13, "<|endoftext|> x", ""),
    (14, "one two three four five six seven", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])
