"""Shared opponents by groups: no join of histories, whatever the groups."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

import __spark_entry__ as entry
from ringside.operators import opponents, ratings, shared
from ringside.plans.dialect import Plan
from ringside.plans.opponents import UNWEIGHED


def _plan(spark) -> str:
    return entry.queries()["common_opponents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_the_query_joins_no_histories(spark):
    """Its plan's joins are those of the tables, by order and customer."""
    joins = [x for x in _plan(spark).splitlines() if "Join" in x]
    assert joins and not any("fighter" in x or "fight_url" in x for x in joins)


@pytest.mark.parametrize(("bounds", "slices"), [([], 1), (["c", "e", "f"], 3)])
def test_the_same_sums_as_by_joins(spark, monkeypatch, bounds, slices):
    rng, day0, rows = random.Random(3), date(2004, 2, 29), []
    for tick in range(90):
        who = rng.sample("abcdefgh", 4)
        for k in (0, 2):
            x, y = who[k : k + 2]
            when = day0 + timedelta(20 * tick)
            rows.append((f"f{tick:02}{k}", tick, 20 * tick, when, x, y, rng.choice([x, y, None]), rng.choice(["KO/TKO", "Decision"])))
    rows.append(("self", 90, 1800, day0 + timedelta(1800), "a", "a", None, "Draw"))
    bouts = spark.createDataFrame(rows, "fight_url string, tick int, day long, event_date date, a string, b string, winner string, method string")
    sides = [(r[0], s, r[1], r[3], r[4 + s], r[5 - s], int(r[6] == r[4 + s]), int(r[6] is not None and r[6] != r[4 + s])) for r in rows for s in (0, 1)]
    flags = spark.createDataFrame(sides, "fight_url string, side int, tick int, event_date date, fighter string, opponent string, won int, lost int")
    joined = Plan((("flags", lambda d: "SELECT * FROM " + d.table("flags_given")), *UNWEIGHED)).run(spark, {"flags_given": flags})
    prestige = spark.createDataFrame([(f, t, rng.random()) for f in "abcdefg" for t in (0, 30, 60)], "fighter string, tick int, score double")
    elo = ratings.rated(bouts, ("elo",), after_all=True).where("v0 is not null").selectExpr("fighter", "tick", "v0 AS elo")
    monkeypatch.setattr(shared, "BOUTS", -(-len(rows) // slices))
    want = {r.fight_url: r for r in opponents.common(bouts, joined, elo, prestige).collect()}
    got = {r.fight_url: r for r in shared.finished(shared.sums(bouts, bounds, len(rows), elo, prestige)).collect()}
    assert got.keys() == want.keys() and sum(r.n_common_opponents for r in want.values()) > 200
    for url, r in want.items():
        assert tuple(got[url]) == pytest.approx(tuple(r)), url


def test_groups_are_about_even(spark, monkeypatch):
    monkeypatch.setattr(shared, "ENTRIES", 100)
    assert shared.bounds_of(spark.range(1000), "id", 100) == []
    assert shared.bounds_of(spark.range(1000), "id", 400) == pytest.approx([250, 500, 750], abs=2)
