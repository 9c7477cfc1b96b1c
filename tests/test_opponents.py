"""Common opponents with prior ratings and prestige, against plain loops."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pytest

from ringside.operators import opponents, ratings
from ringside.plans.dialect import Plan
from ringside.plans.opponents import DECAY, UNWEIGHED


def test_weights_are_those_before_the_tick(spark):
    rng, day0 = random.Random(2), date(2000, 1, 1)
    rows = []
    for tick in range(60):
        who = rng.sample("abcdefgh", 4)
        for k in (0, 2):
            x, y = sorted(who[k : k + 2])
            rows.append((f"f{tick:02}{k}", tick, tick * 40, day0 + timedelta(40 * tick), x, y, rng.choice([x, y, None]), rng.choice(["KO/TKO", "Decision"])))
    prestige = [(f, t, rng.random()) for f in "abcdefg" for t in (0, 20, 40)]
    bouts = spark.createDataFrame(rows, "fight_url string, tick int, day long, event_date date, a string, b string, winner string, method string")
    sides = [(r[0], s, r[1], r[3], r[4 + s], r[5 - s], int(r[6] == r[4 + s]), int(r[6] is not None and r[6] != r[4 + s])) for r in rows for s in (0, 1)]
    flags = spark.createDataFrame(sides, "fight_url string, side int, tick int, event_date date, fighter string, opponent string, won int, lost int")
    shared = Plan((("flags", lambda d: "SELECT * FROM " + d.table("flags_given")), *UNWEIGHED)).run(spark, {"flags_given": flags})
    elo = ratings.rated(bouts, ("elo",), after_all=True).where("v0 is not null").selectExpr("fighter", "tick", "v0 AS elo")
    got = {r.fight_url: r for r in opponents.common(bouts, shared, elo, spark.createDataFrame(prestige, "fighter string, tick int, score double")).collect()}

    state, weighed = ratings.Elo(), 0
    for tick in range(60):
        today = [r for r in rows if r[1] == tick]
        for url, _, _, day, a, b, *_ in today:
            past = {f: [(o, d, w, n) for _, _, t, d, x, o, w, n in sides if x == f and t < tick] for f in (a, b)}
            recent = {f: {o for o, d, _, _ in past[f] if (d.year + 3, d.month, d.day) >= (day.year, day.month, day.day) and o not in (a, b)} for f in (a, b)}
            score = dict.fromkeys((a, b), 0.0)
            for o in recent[a] & recent[b]:
                known = state.seen(o)[0]
                quality = 0.5 * max((1500 if known is None else known) - 1000, 0) / 1000 + 0.5 * max(((t, s) for f, t, s in prestige if f == o and t <= tick), default=(0, 0.0))[1]
                age = [(day - max(d for x, d, _, _ in past[f] if x == o)).days / 365.25 for f in (a, b)]
                for f in (a, b):
                    won, decided = sum(w for x, _, w, _ in past[f] if x == o), sum(w + n for x, _, w, n in past[f] if x == o)
                    score[f] += quality * (math.exp(-DECAY * age[0]) + math.exp(-DECAY * age[1])) / 2 * (won / decided if decided else 0)
            n = len(recent[a] & recent[b])
            weighed += n
            assert got[url].n_common_opponents == n
            if n:
                assert (got[url].common_opp_score_a, got[url].common_opp_score_b) == pytest.approx((score[a], score[b]))
            else:
                assert got[url].common_opp_score_a is None
        for r in today:
            state.apply(r[2], r[4], r[5], r[6], r[7])
    assert weighed > 100 and len(got) == len(rows)
