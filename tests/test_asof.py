"""Events around moments, against a walk over every pair."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.asof import around, dealt
from tallyhouse.operators.scratch import written


def walked(moments, events):
    out = []
    for g, o, x, tag in moments:
        own = [(eo, ex) for eg, eo, ex in events if eg == g]
        before = max(((eo, ex) for eo, ex in own if eo < o), default=None, key=lambda e: e[0])
        after = min((eo for eo, ex in own if eo >= o and ex != x), default=None)
        out.append((g, o, x, tag, before, after))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "groups", "people"), [(1, 4, 3), (2, 1, 2), (3, 40, 5)])
def test_around(spark, seed, groups, people):
    """One group over all ranges, long runs of one person, null groups and people, moments at the place of an event."""
    rng = random.Random(seed)
    places = rng.sample(range(400), 150)
    events = [(rng.choice([None, *map(str, range(groups))]), o, rng.choice([None, *"abcde"[:people]])) for o in places]
    events = [(g, o, "a" if 100 < o < 300 else x) for g, o, x in events]
    moments = [(rng.choice([None, *map(str, range(groups))]), rng.randrange(400), rng.choice([None, *"abcde"[:people]]), i) for i in range(200)]
    m = spark.createDataFrame(moments, "g string, o int, x string, before_ int")
    e = spark.createDataFrame(events, "g string, o int, x string")
    for partitions in (1, 7):
        got = [(*r[:4], r["before"] and tuple(r["before"]), r["next_other"]) for r in around(m, e, "g", "o", "x", partitions).collect()]
        assert sorted(got, key=repr) == walked(moments, events)


def test_looking_back_alone(spark):
    """Without ``ahead`` the same last events and nothing else, over one range and over many."""
    rng = random.Random(4)
    events = [(rng.choice([None, "0", "1"]), o, rng.choice([None, "a", "b"])) for o in rng.sample(range(400), 150)]
    moments = [(rng.choice([None, "0", "1", "2"]), rng.randrange(400), rng.choice([None, "a", "b"]), i) for i in range(200)]
    m = spark.createDataFrame(moments, "g string, o int, x string, before_ int")
    e = spark.createDataFrame(events, "g string, o int, x string")
    for partitions in (1, 7):
        got = around(m, e, "g", "o", "x", partitions, False)
        assert got.columns == ["g", "o", "x", "before_", "before"]
        rows = [(*r[:4], r["before"] and tuple(r["before"])) for r in got.collect()]
        assert sorted(rows, key=repr) == sorted([r[:5] for r in walked(moments, events)], key=repr)


@pytest.mark.parametrize("ranges", [1, 4])
def test_places_dealt_out_before(spark, ranges):
    """The ranges of the places serve; some moments are events themselves and do not see their own."""
    rng = random.Random(ranges)
    rows = [
        (rng.choice([None, "0", "1"]), o, rng.choice([None, "a", "b"]), rng.choice([True, False, None]), rng.random() < 0.4)
        for o in rng.sample(range(400), 300)
    ]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(ranges == 1).lower())
    try:
        df = written(dealt(spark.createDataFrame(rows, "g string, o int, x string, own boolean, event boolean"), "o"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert df.select("o.part").distinct().count() == ranges
    moments, events = df.where("not event").drop("event"), df.where("event").select("g", "o", "x")
    got = around(moments, events, "g", "o", "x", None, False, ranges, "own").collect()
    known = [(g, o, x) for g, o, x, own, event in rows if event or own]
    want = walked([r[:4] for r in rows if not r[4]], known)
    plain = [(r["g"], r["o"]["place"], r["x"], r["own"], r["before"] and (r["before"]["at"]["place"], r["before"]["who"])) for r in got]
    assert sorted(plain, key=repr) == sorted([r[:5] for r in want], key=repr)
    with pytest.raises(ValueError):
        around(moments, events, "g", "o", "x", None, True, ranges)


def test_without_events_or_moments(spark):
    m = spark.createDataFrame([("g", 1, "x")], "g string, o int, x string")
    assert [tuple(r) for r in around(m, m.where("false"), "g", "o", "x").collect()] == [("g", 1, "x", None, None)]
    assert around(m.where("false"), m, "g", "o", "x").collect() == []


def test_one_group_takes_linear_time(spark):
    """Twenty thousand moments among twenty thousand events of one group: four hundred million pairs, were they formed."""
    n = 20_000
    e = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 2).alias("o"), (F.col("id") % 3).alias("x"))
    m = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 2 + 1).alias("o"), (F.col("id") % 2).alias("x"))
    start = time.monotonic()
    rows = around(m, e, "g", "o", "x").collect()
    assert time.monotonic() - start < 60
    assert len(rows) == n
    for r in rows[:: n // 50]:
        k = (r["o"] - 1) // 2
        assert tuple(r["before"]) == (2 * k, k % 3)
        after = next((2 * j for j in range(k + 1, min(k + 3, n)) if j % 3 != r["x"]), None)
        assert r["next_other"] == after
