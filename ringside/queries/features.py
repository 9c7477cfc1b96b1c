"""Replayed state and feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import card
from ..plans import features as F
from ..plans.bouts import FIGHTERS_FROM_SALES, FROM_SALES
from ..plans.dialect import Dialect, Duck, columns
from ..plans.replay import RATES, RECORD_ONLY, REPLAY, SUMS, VARIED
from .base import Registry, tables

_r = Registry()
SALES = ("lineitem", "orders", "customer")

PRIOR = "(PARTITION BY fighter ORDER BY tick RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _career_prior(d: Dialect) -> str:
    n = lambda c: f"CAST(coalesce(sum({c}) OVER prior, 0) AS BIGINT)"
    return f"""SELECT fight_url, side, fighter, {n('1')} AS fights, {n('won')} AS wins, {n('lost')} AS losses,
  round({n('won')} / nullif(CAST({n('1')} AS DOUBLE), 0), 6) AS win_pct
FROM flags WINDOW prior AS {PRIOR}"""


_r.plan("bouts", FROM_SALES.then(("out", lambda d: "SELECT fight_url, event_url, CAST(event_date AS VARCHAR(10)) AS event_date, tick, a, b, winner, method, ending_round, ending_time, round(minutes, 6) AS minutes, time_format, weight_class, CAST(bout_order AS DOUBLE) AS bout_order, has, CAST(a_sig_l AS DOUBLE) AS a_sig_l, CAST(b_sig_l AS DOUBLE) AS b_sig_l, CAST(a_ctrl AS DOUBLE) AS a_ctrl, CAST(b_ctrl AS DOUBLE) AS b_ctrl FROM bouts")), *SALES)
_r.plan("career_prior", FROM_SALES.then(*RECORD_ONLY, ("out", _career_prior)), *SALES)

_replayed = FROM_SALES.then(*REPLAY)
_r.plan("career_full", _replayed.then(("out", lambda d: f"SELECT fight_url, side, {columns(SUMS)}, CAST(debut_date AS VARCHAR(10)) AS debut_date, CAST(last_state.day AS VARCHAR(10)) AS last_fight_date, last_state.method AS last_fight_method FROM prior_state")), *SALES)
_r.plan("streak", _replayed.then(("out", lambda d: "SELECT fight_url, side, fighter, CAST(last_state.streak AS DOUBLE) AS current_streak FROM prior_state")), *SALES)
_r.plan("activity_windows", _replayed.then(("out", lambda d: "SELECT fight_url, side, fights_12mo, fights_3yr, fights_5yr FROM prior_state")), *SALES)
_r.plan("rolling_avg", _replayed.then(("out", lambda d: "SELECT fight_url, side, " + columns(f"round(rolling.avg_{r}, 6) AS {r}" for r in RATES) + " FROM prior_state")), *SALES)
_r.plan("rolling_var", _replayed.then(("out", lambda d: "SELECT fight_url, side, " + columns(f"round(rolling.var_{r}, 6) AS var_{r}" for r in VARIED) + " FROM prior_state")), *SALES)
_r.plan("weight_history", _replayed.then(("out", lambda d: "SELECT fight_url, side, last_state.first_class AS first_class, last_state.klass AS current_class, CAST(last_state.moves AS DOUBLE) AS migrations, CAST(last_state.class_n AS DOUBLE) AS fights_at_class, CAST(last_state.class_won AS DOUBLE) AS wins_at_class FROM prior_state")), *SALES)
_r.plan("recent_form", _replayed.then(("out", lambda d: "SELECT fight_url, side, round(CASE WHEN fights >= 3 THEN last_state.won_last3 END, 6) AS true_win_pct_last3, round(CASE WHEN fights >= 5 THEN last_state.won_last5 END, 6) AS true_win_pct_last5 FROM prior_state")), *SALES)
_r.plan("experience_state", _replayed.then(("out", lambda d: "SELECT fight_url, side, title_fights, CAST(first_title_date AS VARCHAR(10)) AS first_title_date, five_round_fights, five_round_wins FROM prior_state")), *SALES)
_r.plan("rematch_state", _replayed.then(("out", lambda d: "SELECT fight_url, side, meeting.fight_url AS first_fight_url, CAST(meeting.day AS VARCHAR(10)) AS first_day, meeting.method AS first_method, CAST(meeting.upto AS DOUBLE) AS fights_upto FROM prior_state")), *SALES)

_framed = FROM_SALES.then(FIGHTERS_FROM_SALES, *REPLAY, *F.FRAME_ALL)
_r.plan("class_p75", FROM_SALES.then(FIGHTERS_FROM_SALES, *RECORD_ONLY, *F.LIMITS, ("out", lambda d: "SELECT CAST(yr AS BIGINT) AS yr, weight_class, reach_p75, height_p75 FROM class_limits")), *SALES, "supplier")
for _name in F.FAMILIES:
    _r.plan(f"emit_{_name}", _framed.then(F.family_part(_name, 6)), *SALES, "supplier")
_r.plan("features_wide", _framed.then(F.wide_part(6)), *SALES, "supplier")


def _pivoted(d: Dialect) -> str:
    """One row a bout: numeric features of both sides, and the outcome."""
    shown = ("total_ufc_fights", "win_pct_all", "current_streak", "finish_rate", "sig_strikes_per_min", "striking_accuracy_pct", "height_cm", "reach_cm", "age_at_fight")
    both = [f"max(CASE WHEN side = {i} THEN {c} END) AS {c}_{s}" for c in shown for i, s in enumerate("ab")]
    return f"SELECT w.fight_url, {columns(both)}, max(CASE WHEN side = 0 THEN reach_delta END) AS reach_delta FROM wide w GROUP BY w.fight_url"


_r.plan("fight_pivot", _framed.then(F.wide_part(6), ("out", _pivoted)), *SALES, "supplier")


_carded = FROM_SALES.then(*REPLAY[:3], F.CARD, ("out", lambda d: f"SELECT fight_url, side, {columns(F.shown_card(6))} FROM card"))
_listed = FROM_SALES.then(REPLAY[0], card.LISTED)


def emit_card_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = card.averages(_listed.run(spark, tables(spark, sf_dir, *SALES)))
    return rows.selectExpr("fight_url", "side", *F.shown_card(6))


_r.add("emit_card_position", emit_card_position, _carded.text(Duck()))


def _sparse(d: Dialect) -> str:
    """Prior bouts by date on both sides, and whether either has fewer than 3."""
    return f"""SELECT fight_url, CAST(min(n) AS BIGINT) AS min_prior_fights, min(n) < 3 AS is_sparse
FROM (SELECT fight_url, coalesce(sum(1) OVER (PARTITION BY fighter ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM sides) s GROUP BY fight_url"""


_r.plan("sparse_history", FROM_SALES.then(*RECORD_ONLY[:1], ("out", _sparse)), *SALES)

QUERIES, SQL = _r.queries, _r.sql
