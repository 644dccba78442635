"""Jobs whose requests depend on each other, against a walk through the requests one by one."""

from __future__ import annotations

import random
import re

import pytest

from tallyhouse.constants import PHONE_PATTERN
from tallyhouse.operators import asof, scratch, settle
from tallyhouse.plans import company_changes
from tallyhouse.plans.company_changes import modify_companies
from tallyhouse.plans.company_jobs import (
    add_companies,
    add_company_admins,
    change_company_admins,
    delete_admin_accounts,
    remove_company_admins,
)

from tables import HandTables, requests

PHONES = [f"1380000000{i}" for i in range(6)] + ["bad"]


def valid(phone):
    return bool(phone) and re.search(PHONE_PATTERN, phone) is not None


def accepted_ids(result):
    ok = {r["req_id"] for r in result.accepted.collect()}
    no = {r["req_id"] for r in result.rejected.collect()}
    assert not ok & no
    return ok, no


def in_order(rows, time_at=-1):
    return sorted(rows, key=lambda r: (r[time_at], r[0]))


@pytest.mark.parametrize("seed", range(4))
def test_add_companies(spark, seed):
    rnd = random.Random(seed)
    hot = seed == 3
    rows = [
        (
            i, f"T{0 if hot and i % 3 == 0 else rnd.randrange(8)}", rnd.choice(["c", "c", ""]),
            PHONES[0] if hot and i % 3 == 1 else rnd.choice(PHONES), "R", "X", rnd.randrange(9),
        )
        for i in range(60)
    ]
    factorys = [{"id": "F0", "title": "T7", "administrators": [PHONES[5]]}, {"id": "F1", "title": "z", "administrators": [PHONES[4], PHONES[3]]}]
    members = [{"phone": PHONES[2], "factory": "F1", "rights": ["3"]}]
    t = HandTables(spark, factorys=factorys, factory_users=members)
    ddl = "req_id long, company_name string, contact string, administrators string, company_area string, company_category string, req_time long"
    titles, admins, want = {"T7", "z"}, {PHONES[5], PHONES[2]}, set()
    for r in in_order(rows):
        if r[1] and r[2] and r[3] and valid(r[3]) and r[3] not in admins and r[1] not in titles:
            want.add(r[0])
            admins.add(r[3])
            titles.add(r[1])
    result = add_companies(t, requests(spark, ddl, rows))
    ok, no = accepted_ids(result)
    assert ok == want and len(ok) + len(no) == len(rows)
    assert result.table(t, "factorys").count() == 2 + len(want)


def walked(rows):
    taken, won = set(), set()
    for o, *keys in sorted(rows):
        if not taken & set(keys):
            won.add(o)
            taken |= set(keys) - {None}
    return won


def test_a_chain_of_requests_is_not_settled_round_by_round(spark, monkeypatch):
    """Each of 2,000 requests conflicts with the one before it alone, so no two could be decided in one round."""
    touched = []

    def watched(df):
        out = scratch.written(df)
        touched.append(out.count())
        return out

    monkeypatch.setattr(settle, "written", watched)
    n = 2_000
    rows = [(i, f"a{i // 2}", f"t{(i + 1) // 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "o long, a string, t string")
    got = settle.settle(df, "o", ["a", "t"], ["a", "t"])
    assert {r["o"] for r in got.where("accepted").collect()} == walked(rows) == set(range(0, n, 2))
    assert sum(touched) <= 5 * n


@pytest.mark.parametrize("seed", range(3))
def test_walks_and_rounds_agree(spark, monkeypatch, seed):
    """Blocks far smaller than the chains, several chains beside free requests, null keys."""
    monkeypatch.setattr(settle, "BLOCK", 40)
    monkeypatch.setattr(settle, "STALLED", 0.3 if seed else 0.9)
    rng = random.Random(seed)
    rows = [(3 * i, f"a{i // 2}", f"t{(i + 1) // 2}") for i in range(90)]
    rows += [(3 * i + 1, f"b{rng.randrange(60)}", rng.choice([None, f"a{rng.randrange(45)}", f"t{rng.randrange(45)}"])) for i in range(90)]
    got = settle.settle(spark.createDataFrame(rows, "o long, a string, t string"), "o", ["a", "t"], ["a", "t"])
    assert got.count() == len(rows)
    assert {r["o"] for r in got.where("accepted").collect()} == walked(rows)


@pytest.mark.parametrize("seed", range(4))
def test_delete_admin_accounts(spark, seed):
    rnd = random.Random(seed)
    accounts = [
        {"username": f"u{i}", "phone": PHONES[i] if i < 6 else "short", "rights": "0" if i < 5 else "1", "name": "n", "time": 1}
        for i in range(7)
    ]
    accounts += [
        {"username": name, "phone": None, "rights": rights, "name": "n", "time": 1} for name, rights in (("admin", "0"), ("clerk", "1"))
    ]
    actors = [a["phone"] for a in accounts if a["phone"]] + [a["username"] for a in accounts] + ["nobody"]
    targets = [a["phone"] for a in accounts if a["phone"]] + ["u1", "13899999999", None]
    rows = [(i, rnd.choice(actors), rnd.choice(targets), rnd.randrange(9)) for i in range(50)]
    t = HandTables(spark, bg_user=accounts)
    alive, want = {a["phone"] or a["username"]: a for a in accounts}, set()
    for req, actor, target, _ in in_order(rows):
        if target is None:
            continue
        key = "phone" if valid(target) else "username"
        who = [a for a in alive.values() if a[key] == actor]
        if who and who[0]["rights"] == "0":
            want.add(req)
            alive.pop(target, None)
    result = delete_admin_accounts(t, requests(spark, "req_id long, actor string, phone string, req_time long", rows))
    ok, _ = accepted_ids(result)
    assert ok == want
    assert {r["phone"] or r["username"] for r in result.table(t, "bg_user").collect()} == set(alive)


@pytest.mark.parametrize("seed", [0, 1, 5, 6, 7, 10])
def test_modify_companies(spark, seed):
    rnd = random.Random(seed)
    names = [f"F{i}" for i in range(5)]
    phones = PHONES[: rnd.choice([3, 5])]
    factorys = [
        {"id": f, "name": "n", "title": "t", "time": 1, "administrators": rnd.choice([[rnd.choice(phones)], [rnd.choice(phones)], phones[:2], None])}
        for f in names
    ]
    members = [
        {"phone": p, "factory": rnd.choice(names), "rights": ["3"], "time": 1, "name": "m"}
        for p in phones for _ in range(rnd.choice([0, 0, 1, 1, 2 if seed % 2 else 0]))
    ]
    hot = seed >= 7
    rows = [
        (
            i, names[0] if hot and rnd.random() < 0.6 else rnd.choice([*names, "none", ""]), f"C{i}", f"k{i}",
            phones[0] if hot and rnd.random() < 0.5 else rnd.choice([*phones, "bad"]), "R", "X", "", "", rnd.randrange(20),
        )
        for i in range(60)
    ]
    ddl = (
        "req_id long, factory_id string, company_name string, contact string, administrators string, company_area string, "
        "company_category string, auth_file string, business_licence string, req_time long"
    )
    t = HandTables(spark, factorys=factorys, factory_users=members)
    admins = {f["id"]: f["administrators"] for f in factorys}
    held = [(m["phone"], m["factory"], m["name"]) for m in members]
    want = set()
    for req, f, _, contact, x, *_ in in_order(rows):
        if not f or not valid(x) or f not in admins:
            continue
        if sum(a == [x] for a in admins.values()) > 1 or sum(h[0] == x for h in held) > 1:
            continue
        want.add(req)
        admins[f] = [x]
        held = [h for h in held if h[:2] != (x, f)] + [(x, f, contact)]
    result = modify_companies(t, requests(spark, ddl, rows))
    ok, no = accepted_ids(result)
    assert ok == want and len(ok) + len(no) == len(rows)
    assert {r["id"]: r["administrators"] for r in result.table(t, "factorys").collect()} == admins
    after = sorted((r["phone"], r["factory"], r["name"]) for r in result.table(t, "factory_users").collect())
    assert after == sorted(held)


def test_taking_turns_at_a_company_needs_no_round_for_each(spark, monkeypatch):
    """Two phones that each lead another company take their home from each other, request by request."""
    asked = [(i, "F0", PHONES[i // 2 % 2]) for i in range(80)]
    asked += [(80, "F1", PHONES[2]), (81, "F0", PHONES[0]), (82, "F0", PHONES[0]), (83, "F2", PHONES[0]), (84, "F0", PHONES[0])]
    rows = [(i, f, "C", "k", x, "R", "X", "", "", i) for i, f, x in asked]
    factorys = [
        {"id": f, "name": "n", "title": "t", "time": 1, "administrators": [x]}
        for f, x in [("F0", PHONES[2]), ("F1", PHONES[0]), ("F2", PHONES[2]), ("F3", PHONES[1])]
    ]
    members = [{"phone": x, "factory": "F0", "rights": ["3"], "time": 1, "name": "m"} for x in PHONES[:2]]
    members += [{"phone": PHONES[2], "factory": "F1", "rights": ["3"], "time": 1, "name": "m"}]
    passes = []
    inner = company_changes.around
    monkeypatch.setattr(company_changes, "around", lambda *a: passes.append(1) or inner(*a))
    ddl = (
        "req_id long, factory_id string, company_name string, contact string, administrators string, company_area string, "
        "company_category string, auth_file string, business_licence string, req_time long"
    )
    ok, no = accepted_ids(modify_companies(HandTables(spark, factorys=factorys, factory_users=members), requests(spark, ddl, rows)))
    # The second of two requests in turn finds the phone leading two companies; the third phone sets the first one free.
    assert ok == {*range(0, 80, 2), 80, 81, 82, 83} and len(no) == len(rows) - len(ok)
    assert len(passes) <= 8


def test_a_pass_looks_back_once(spark, monkeypatch):
    """The last pass already tells who led a company when; nothing is laid into order again after it."""
    asked = [(i, "F0", PHONES[i // 2 % 2]) for i in range(12)] + [(12, "F1", PHONES[2]), (13, "F0", PHONES[0])]
    rows = [(i, f, "C", "k", x, "R", "X", "", "", i) for i, f, x in asked]
    factorys = [
        {"id": f, "name": "n", "title": "t", "time": 1, "administrators": [x]}
        for f, x in [("F0", PHONES[2]), ("F1", PHONES[0]), ("F3", PHONES[1])]
    ]
    members = [{"phone": x, "factory": "F0", "rights": ["3"], "time": 1, "name": "m"} for x in PHONES[:2]]
    calls = {"around": 0, "_placed": 0}

    def counted(owner, name):
        inner = getattr(owner, name)

        def call(*a):
            calls[name] += 1
            return inner(*a)

        monkeypatch.setattr(owner, name, call)

    counted(company_changes, "around")
    counted(company_changes, "_placed")
    ddl = (
        "req_id long, factory_id string, company_name string, contact string, administrators string, company_area string, "
        "company_category string, auth_file string, business_licence string, req_time long"
    )
    result = modify_companies(HandTables(spark, factorys=factorys, factory_users=members), requests(spark, ddl, rows))
    # Both of the first phones lead another company too; once the third has F1, the first one is free.
    assert sorted(r["req_id"] for r in result.accepted.collect()) == [*range(0, 12, 2), 12, 13]
    assert calls["around"] == calls["_placed"] >= 1


MODIFY = (
    "req_id long, factory_id string, company_name string, contact string, administrators string, company_area string, "
    "company_category string, auth_file string, business_licence string, req_time long"
)


def turns(spark, seed, n):
    """Random requests of a few phones that lead several companies, most for one company: (job input, rows, accepted ids)."""
    rnd = random.Random(seed)
    names, phones = [f"F{i}" for i in range(9)], PHONES[:5]
    led = {f: rnd.choice(phones) for f in names}
    held = {(x, f) for x in phones[1:] for f in [rnd.choice(names[:2])]}
    factorys = [{"id": f, "name": "n", "title": "t", "time": 1, "administrators": [x]} for f, x in led.items()]
    members = [{"phone": x, "factory": f, "rights": ["3"], "time": 1, "name": "m"} for x, f in sorted(held)]
    rows = [
        (i, rnd.choice([*names[:2], *names[:2], *names[:2], rnd.choice(names)]), "C", "k", rnd.choice(phones), "R", "X", "", "", rnd.randrange(n))
        for i in range(n)
    ]
    want = set()
    for req, f, _, _, x, *_ in in_order(rows):
        if list(led.values()).count(x) <= 1 and sum(h[0] == x for h in held) <= 1:
            want.add(req)
            led[f] = x
            held.add((x, f))
    return HandTables(spark, factorys=factorys, factory_users=members), requests(spark, MODIFY, rows), want


@pytest.mark.parametrize("seed", range(5))
def test_modify_companies_over_many_ranges(spark, monkeypatch, seed):
    """Places dealt out in several ranges, so that who leads a company is carried over their borders."""
    t, asked, want = turns(spark, seed, 150)
    ranges, inner = [], company_changes.around
    monkeypatch.setattr(company_changes, "around", lambda *a: ranges.append(a[7]) or inner(*a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ok, no = accepted_ids(modify_companies(t, asked))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ok == want and len(no) == 150 - len(want)
    assert ranges and min(ranges) > 1


def test_a_pass_writes_two_tables(spark, monkeypatch):
    """What requests come to, and what that says of the phones; besides, seven tables for a batch whatever its passes."""
    t, asked, want = turns(spark, 3, 150)
    tables, passes = [], []
    for owner in (company_changes, asof):
        monkeypatch.setattr(owner, "written", lambda df: tables.append(1) or scratch.written(df))
    inner = company_changes._placed
    monkeypatch.setattr(company_changes, "_placed", lambda *a: passes.append(1) or inner(*a))
    ok, _ = accepted_ids(modify_companies(t, asked))
    assert ok == want and passes
    assert len(tables) <= 7 + 2 * len(passes)


@pytest.mark.parametrize("seed", range(3))
def test_membership_jobs(spark, seed):
    rnd = random.Random(seed)
    base = [(rnd.choice(PHONES[:5]), f"F{rnd.randrange(3)}") for _ in range(6)]
    members = [{"phone": p, "factory": f, "rights": ["3"], "name": "m", "time": 1} for p, f in base]
    t = HandTables(spark, factory_users=members, user_info=[{"phone": PHONES[0], "name": "zero"}, {"phone": PHONES[1], "name": None}])

    adds = [(i, f"F{rnd.randrange(3)}", rnd.choice(PHONES), rnd.choice([["5", "3", "5"], []]), rnd.randrange(5)) for i in range(30)]
    held, want = list(base), set()
    for req, f, p, rights, _ in in_order(adds):
        if rights and valid(p) and sum(h[0] == p for h in held) != 1:
            want.add(req)
            held.append((p, f))
    result = add_company_admins(
        t, requests(spark, "req_id long, factory_id string, new_administrators string, permission array<string>, req_time long", adds)
    )
    assert accepted_ids(result)[0] == want
    added = result.appended["factory_users"].collect()
    assert all(r["rights"] == ["3", "5"] for r in added)
    assert {r["phone"]: r["name"] for r in added if r["phone"] in PHONES[:2]}.items() <= {PHONES[0]: "zero", PHONES[1]: ""}.items()

    swaps = [(i, f"F{rnd.randrange(2)}", rnd.choice(PHONES[:4]), rnd.choice(PHONES[:4]), ["7"], rnd.randrange(9)) for i in range(40)]
    held = list(base)
    for _, f, old, new, _, _ in in_order(swaps):
        held = [h for h in held if h != (old, f)] + [(new, f)]
    result = change_company_admins(
        t,
        requests(
            spark,
            "req_id long, factory_id string, administrators string, new_administrators string, permission array<string>, req_time long",
            swaps,
        ),
    )
    assert sorted((r["phone"], r["factory"]) for r in result.table(t, "factory_users").collect()) == sorted(held)

    drops = [(i, f"F{rnd.randrange(3)}", rnd.choice([*PHONES[:5], ""]), rnd.randrange(5)) for i in range(25)]
    held, want = list(base), set()
    for req, f, p, _ in in_order(drops):
        if p and (p, f) in held:
            want.add(req)
            held = [h for h in held if h != (p, f)]
    result = remove_company_admins(
        t, requests(spark, "req_id long, factory_id string, administrators string, req_time long", drops)
    )
    assert accepted_ids(result)[0] == want
    assert sorted((r["phone"], r["factory"]) for r in result.table(t, "factory_users").collect()) == sorted(held)
