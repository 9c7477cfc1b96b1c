"""One planted defect, one finding; clean data gives none."""

from __future__ import annotations

from datetime import date

import pytest

from ringside.plans import quality as Q
from ringside.plans.dialect import Plan

TODAY = "2025-01-01"
STAT = {"knockdowns": 0, "significant_strikes_landed": 30, "significant_strikes_attempted": 60, "total_strikes_landed": 40, "total_strikes_attempted": 80, "takedowns_landed": 2, "takedowns_attempted": 4, "submission_attempts": 0, "reversals": 0, "control_time_seconds": 120}
ROUND = {**STAT, "significant_strikes_landed": 10, "significant_strikes_attempted": 20, "total_strikes_landed": 10, "total_strikes_attempted": 20, "control_time_seconds": 40}


def clean():
    rounds = [{"fight_url": "x", "fighter_url": "a", "round": i + 1, **ROUND, "takedowns_landed": (1, 0, 1)[i], "takedowns_attempted": (2, 1, 1)[i]} for i in range(3)]
    split = {f"{n}_{k}": v for n, v in (("head", 20), ("body", 5), ("leg", 5), ("distance", 25), ("clinch", 3), ("ground", 2)) for k, v in (("landed", v), ("attempted", 2 * v))}
    return {
        "contests": [{"event_url": "old", "date": date(2004, 10, 22)}, {"event_url": "new", "date": date(2024, 4, 13)}],
        "fighters": [{"fighter_url": f, "height_cm": 180.0, "reach_cm": 185.0, "weight_kg": 77.0} for f in "ab"],
        "fights": [{"fight_url": "x", "event_url": "new", "fighter_a_url": "a", "fighter_b_url": "b", "winner_url": "a", "ending_round": 3, "ending_time": "5:00", "time_format": "3 Rnd (5-5-5)"}],
        "fight_totals": [{"fight_url": "x", "fighter_url": "a", **STAT}], "round_stats": rounds, "sig_strike_breakdowns": [{"fight_url": "x", "fighter_url": "a", "round": 0, **split}],
    }


def findings(spark, data, part=None):
    tables = {k: spark.createDataFrame([tuple(r.values()) for r in v], list(v[0])) for k, v in data.items()}
    plan = Plan((Q.all_findings(TODAY), part or ("out", lambda d: "SELECT * FROM violations")))
    return plan.run(spark, tables).collect()


DEFECTS = [
    ("LANDED_GT_ATTEMPTED", "fight_totals", {"takedowns_landed": 9}, "takedowns_landed=9 > takedowns_attempted=4"),
    ("NEGATIVE_STAT", "fight_totals", {"submission_attempts": -1}, "submission_attempts=-1 is negative"),
    ("ROUND_SUM_MISMATCH", "fight_totals", {"knockdowns": 2}, "knockdowns: rounds=0 totals=2"),
    ("BREAKDOWN_PARTITION_MISMATCH", "sig_strike_breakdowns", {"leg_landed": 6}, "target split=31 != position split=30"),
    ("SELF_FIGHT", "fights", {"fighter_b_url": "a"}, "fighter_a_url == fighter_b_url"),
    ("WINNER_NOT_IN_FIGHT", "fights", {"winner_url": "c"}, "winner_url=c is neither participant"),
    ("ENDING_ROUND_INVALID", "fights", {"ending_round": 4}, "ending_round=4 outside schedule '3 Rnd (5-5-5)'"),
    ("MEASUREMENT_OUT_OF_RANGE", "fighters", {"height_cm": 300.0}, "height_cm=300.0 outside [120, 230]"),
    ("EVENT_DATE_OUT_OF_RANGE", "contests", {"date": date(1990, 1, 1)}, "event date 1990-01-01 outside [1993-11-12, 2026-02-05]"),
    ("CONTROL_TIME_EXCEEDS_FIGHT", "fight_totals", {"control_time_seconds": 901}, "control_time_seconds=901 > fight duration 900s"),
    ("ORPHAN_ROW", "fights", {"event_url": "gone"}, "event_url not in events"),
]


def test_clean_data_gives_nothing(spark):
    assert findings(spark, clean()) == []


@pytest.mark.parametrize(("reason", "table", "change", "detail"), DEFECTS)
def test_one_defect_one_finding(spark, reason, table, change, detail):
    data = clean()
    data[table][0] |= change
    if reason == "ROUND_SUM_MISMATCH":
        assert [(r.reason_code, r.detail) for r in findings(spark, data)] == [(reason, detail)]
        return
    got = findings(spark, data)
    assert (reason, detail) in {(r.reason_code, r.detail) for r in got}
    assert {r.reason_code for r in got} <= {reason, "ROUND_SUM_MISMATCH"}  # a changed total also misses its rounds


def test_overtime_and_missing_rounds_are_no_defects(spark):
    data = clean()
    data["fights"][0] |= {"time_format": "1 Rnd + 2OT", "ending_round": 3}
    data["round_stats"][0]["fight_url"] = data["round_stats"][1]["fight_url"] = data["round_stats"][2]["fight_url"] = "y"
    assert {r.reason_code for r in findings(spark, data)} == {"ORPHAN_ROW"}


def test_era_report(spark):
    data = clean()
    data["fights"][0] |= {"event_url": "old", "winner_url": "c"}
    (r,) = findings(spark, data, Q.era_report("2010-01-01"))
    assert (r.total_violations, r.pre_cutoff_violations, r.label_universe_violations, r.undated_violations, r.passed) == (1, 1, 0, 0, True)
    data["fights"][0]["event_url"] = "gone"
    (r,) = findings(spark, data, Q.era_report("2010-01-01"))
    assert r.undated_violations == 1 and not r.passed
