"""Windows against an independent replay, and no leakage from later events."""

from __future__ import annotations

from datetime import date
from statistics import mean

import pandas as pd
import pytest
from pyspark.sql import types as T

from ringside.plans import features as F
from ringside.plans.bouts import FIGHTERS_FROM_TABLES, FROM_TABLES
from ringside.plans.replay import REPLAY

from . import replaying

KINDS = {"date": T.DateType(), "date_of_birth": T.DateType(), "height_cm": T.DoubleType(), "reach_cm": T.DoubleType()}
WIDE = FROM_TABLES.then(FIGHTERS_FROM_TABLES, *REPLAY, *F.FRAME_ALL, F.wide_part())


def frames(spark, tables):
    out = {}
    for name, rows in tables.items():
        kind = lambda c, rows=rows: KINDS.get(c) or (T.IntegerType() if any(isinstance(r[c], int) for r in rows) else T.StringType())
        schema = T.StructType([T.StructField(c, kind(c)) for c in rows[0]])
        out[name] = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    return out


def wide(spark, tables) -> dict[tuple[str, str], dict]:
    rows = WIDE.run(spark, frames(spark, tables)).collect()
    return {(r["fight_url"], r["fighter"]): r.asDict() for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_replay(spark, seed):
    t = replaying.tables(seed)
    days = {e["event_url"]: e["date"] for e in t["events"]}
    want, got = replaying.careers(t), wide(spark, t)
    assert set(want) == set(got)
    for f in t["fights"]:
        for who in (f["fighter_a_url"], f["fighter_b_url"]):
            w, g, day = want[f["fight_url"], who], got[f["fight_url"], who], days[f["event_url"]]
            assert g["total_ufc_fights"] == w["fights"] and g["current_streak"] == w["streak"]
            assert g["win_pct_all"] == (pytest.approx(w["wins"] / w["fights"]) if w["fights"] else None)
            assert g["finish_rate"] == pytest.approx((w["ko"] + w["sub"]) / w["wins"] if w["wins"] else 0)
            assert g["days_since_last_fight"] == ((day - w["dates"][-1]).days if w["dates"] else None)
            assert g["fights_last_12mo"] == sum((day - d).days < 365 for d in w["dates"])
            rates = [s for s, _ in w["sig"] if s is not None]
            assert g["sig_strikes_per_min"] == (pytest.approx(mean(rates)) if rates else None)
            assert g["avg_fight_duration_sec"] == (pytest.approx(mean(m for _, m in w["sig"]) * 60) if w["sig"] else None)
            assert g["is_weight_class_change"] == (float(w["classes"][0] != w["classes"][-1]) if w["classes"] else None)


def test_later_events_change_nothing(spark):
    t = replaying.tables(5)
    order = [e["event_url"] for e, _ in replaying.ticks(t)]
    gone = set(order[8:])
    early = {**t, "events": [e for e in t["events"] if e["event_url"] not in gone], "fights": [f for f in t["fights"] if f["event_url"] not in gone]}
    whole, part = wide(spark, t), wide(spark, early)
    assert all(whole[k] == v for k, v in part.items())
    changed = [{**f, "winner_url": f["fighter_a_url"], "method": "KO/TKO"} if f["event_url"] == order[8] else f for f in t["fights"]]
    altered = wide(spark, {**t, "fights": changed})
    upto = {f["fight_url"] for f in t["fights"] if f["event_url"] in order[:9]}
    assert all(altered[k] == v for k, v in whole.items() if k[0] in upto)


def test_sides_mirror_each_other(spark):
    t = replaying.tables(3)
    got = wide(spark, t)
    for f in t["fights"]:
        a, b = (got[f["fight_url"], f[k]] for k in ("fighter_a_url", "fighter_b_url"))
        for c in ("reach_delta", "height_delta", "age_delta", "ufc_experience_delta", "striking_efficiency_delta", "wrestling_delta"):
            assert (a[c] is None and b[c] is None) or a[c] == pytest.approx(-b[c])
        assert a["stance_matchup"] == b["stance_matchup"] and a["grappling_type_mismatch"] == b["grappling_type_mismatch"]


def test_input_order_is_of_no_account(spark):
    t = replaying.tables(4)
    assert wide(spark, t) == wide(spark, {k: v[::-1] for k, v in t.items()})


def test_age_before_the_birthday(spark):
    t = replaying.tables(1)
    for f in t["fighters"]:
        f["date_of_birth"] = date(2000, 2, 29)
    for e in t["events"]:
        e["date"] = date(2023, 2, 28)
    assert {r["age_at_fight"] for r in wide(spark, t).values()} == {22.0}


def test_families_have_all_columns():
    names = [c for f in F.FAMILIES.values() for c in f(__import__("ringside.plans.dialect", fromlist=["Spark"]).Spark())]
    assert len(names) == len(set(names)) == 123 - 13 - 6 - 2  # ratings, card position and rating deltas are joined
    assert pd.Series(names).str.match("^[a-z0-9_]+$").all()
