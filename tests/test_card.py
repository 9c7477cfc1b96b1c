"""Averages by place on the card, against plain loops."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as entry
from ringside.operators import card


def test_the_query_joins_no_histories(spark):
    plan = entry.queries()["emit_card_position"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not any("fighter" in x for x in joins)


def test_five_highest_orders_and_the_rest():
    rng, rows = random.Random(5), []
    for who in "abc":
        for i in range(80):
            rows.append((who, rng.randrange(50), f"f{who}{i:02}", rng.randrange(2), rng.choice([None, *map(float, range(1, 9))]), rng.random() < 0.9, *[rng.choice([None, rng.random() * 9]) for _ in range(3)]))
    rows.sort(key=lambda r: r[:4])
    got = list(card.folded(iter(rows)))
    assert len(got) == len(rows)
    mean = lambda v: sum(v) / len(v) if v else None
    for r, g in zip(rows, got, strict=True):
        past = sorted((x for x in rows if r[4] is not None and x[0] == r[0] and x[1] < r[1] and x[4] is not None and x[5]), key=lambda x: (-x[4], x[1], x[2]))
        want = [r[2], r[3], len(past)]
        for m in (6, 7, 8):
            want += [mean([x[m] for x in part if x[m] is not None]) for part in (past[:5], past[5:])]
        assert list(g) == pytest.approx(want)
