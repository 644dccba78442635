"""Substring filters through postings: the same rows as without, read from few files."""

from __future__ import annotations

import re

import pytest

from tallyhouse.checks.standins import StandIns
from tallyhouse.plans import companies, people
from tallyhouse.sources.tables import ParquetTables
from tallyhouse.sources.textindex import needed_grams

from conftest import SF
from tables import HandTables

NAMES = ("user_info", "user_auth", "factorys", "factory_users", "bg_examine")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The same tables with and without postings; some rows have no key or no text."""
    t = StandIns(spark, SF)
    odd = HandTables(spark, user_info=[
        {"phone": None, "name": "Customer#000000077", "time": 1}, {"phone": "x", "name": None, "time": 1},
        {"phone": "yy", "name": "ab", "time": 1}, {"phone": "zé", "name": "50%_Cüs\\x", "time": 1},
    ])
    roots = [str(tmp_path_factory.mktemp(kind)) for kind in ("plain", "indexed")]
    for root in roots:
        for name in NAMES:
            t[name].unionByName(odd[name]).write.parquet(f"{root}/{name}")
    plain, indexed = (ParquetTables(spark, root) for root in roots)
    indexed.index_text("user_info", "phone", ["phone", "name"], 16)
    indexed.index_text("user_auth", "phone", ["phone", "name"], 16)
    indexed.index_text("factorys", "id", ["title"], 4)
    return plain, indexed


@pytest.mark.parametrize(
    ("phone", "name"),
    [("", ""), ("0001", ""), ("", "0077"), ("", "#00%077"), ("", r"50\%\_C"), ("", "Cüs"), ("", "C_s"), ("", "absent"), ("13", "12"),
     ("1380", "Customer#000000012"), ("", r"s\\x")],
)
def test_filters_find_the_same(both, phone, name):
    plain, indexed = both
    for report in (lambda t: people.users(t, id=phone, name=name), lambda t: people.identity_reviews(t, id=phone, name=name)):
        assert rows_of(report(indexed).rows()) == rows_of(report(plain).rows())


def test_titles(both):
    plain, indexed = both
    for text in ("Company 1", "pany%3", "none such"):
        assert rows_of(companies.companies(indexed, company_name=text).rows()) == rows_of(companies.companies(plain, company_name=text).rows())


def test_a_selective_filter_reads_postings_and_few_folders(both):
    text = people.users(both[1], name="Customer#000000077").rows()._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert not [line for line in scans if re.search(r"indexed\d*/user_info[,\]]", line)]
    table = next(line for line in scans if "_text_index/user_info/rows" in line)
    kept = re.search(r"PartitionFilters: \[[^]]*_bucket#\d+ (IN \(([^)]*)\)|= \d+)", table)
    assert kept and (kept[2] is None or kept[2].count(",") < 8)


def test_an_unselective_filter_reads_the_table(both):
    text = people.users(both[1], id="138").rows()._jdf.queryExecution().executedPlan().toString()
    assert "_text_index" not in text


def test_an_index_of_other_files_is_passed_over(spark, tmp_path):
    first = HandTables(spark, user_info=[{"phone": f"p{i:03d}", "name": f"name{i:03d}", "time": 1} for i in range(50)])
    first["user_info"].write.parquet(f"{tmp_path}/user_info")
    t = ParquetTables(spark, str(tmp_path))
    t.index_text("user_info", "phone", ["name"], 4)
    assert t.cut_by_text("user_info", {"name": "name007"}).count() == 1
    more = HandTables(spark, user_info=[{"phone": "new", "name": "name007", "time": 1}])["user_info"]
    more.write.mode("append").parquet(f"{tmp_path}/user_info")
    assert t.cut_by_text("user_info", {"name": "name007"}).count() == 51
    t.index_text("user_info", "phone", ["name"], 4)
    assert t.cut_by_text("user_info", {"name": "name007"}).count() == 2


def test_needed_grams():
    assert needed_grams("abcd") == {"abc", "bcd"}
    assert needed_grams("ab%cde_f") == {"cde"}
    assert needed_grams(r"a\%b\\c") == {"a%b", "%b\\", "b\\c"}
    assert needed_grams("ab") == needed_grams("") == needed_grams("%_") == set()
