"""Canonical tables made from the star-schema bouts, with planted defects: where
the bout number modulo 97 is a small number, one invariant each is broken."""

from __future__ import annotations

from .dialect import Dialect, Part

K = "CAST(right(fight_url, 11) AS BIGINT) % 97"


def _contests(d: Dialect) -> str:
    return "SELECT DISTINCT event_url, concat('Event ', event_url) AS name, CASE WHEN day % 97 = 5 THEN DATE '1990-01-01' ELSE event_date END AS date FROM bouts"


def _fights(d: Dialect) -> str:
    return f"""SELECT fight_url, CASE WHEN {K} = 1 THEN 'missing' ELSE event_url END AS event_url, a AS fighter_a_url,
  CASE WHEN {K} = 2 THEN a ELSE b END AS fighter_b_url, CASE WHEN {K} = 3 THEN 'nobody' ELSE winner END AS winner_url, method,
  CASE WHEN {K} = 4 THEN 9 ELSE ending_round END AS ending_round, ending_time, CASE WHEN {K} = 5 THEN '1 Rnd + OT' ELSE time_format END AS time_format, weight_class
FROM bouts"""


def _fighters(d: Dialect) -> str:
    return "SELECT fighter AS fighter_url, CASE WHEN height_cm = 173 THEN CAST(90 AS DOUBLE) ELSE height_cm END AS height_cm, reach_cm, CAST(CASE WHEN height_cm = 181 THEN 400 ELSE 77 END AS DOUBLE) AS weight_kg FROM profiles"


def _totals(d: Dialect) -> str:
    own = lambda c: f"CASE WHEN side = 0 THEN a_{c} ELSE b_{c} END"
    return f"""SELECT CASE WHEN {K} = 6 THEN concat('orphan-', fight_url) ELSE fight_url END AS fight_url, CASE WHEN side = 0 THEN a ELSE b END AS fighter_url,
  CASE WHEN {K} = 8 THEN -1 ELSE {own('kd')} END AS knockdowns,
  CASE WHEN {K} = 7 THEN {own('sig_a')} + 1 ELSE {own('sig_l')} END AS significant_strikes_landed, {own('sig_a')} AS significant_strikes_attempted,
  {own('tot_l')} AS total_strikes_landed, {own('tot_a')} AS total_strikes_attempted, {own('td_l')} AS takedowns_landed, {own('td_a')} AS takedowns_attempted,
  {own('sub')} AS submission_attempts, {own('rev')} AS reversals, CASE WHEN {K} = 9 THEN 99999 ELSE {own('ctrl')} END AS control_time_seconds
FROM bouts {d.sides('side')} WHERE has"""


def _third(c: str) -> str:
    return f"CAST(CASE WHEN round < 3 THEN floor({c} / 3) ELSE {c} - 2 * floor({c} / 3) END AS INT)"


def _rounds(d: Dialect) -> str:
    same = ("knockdowns", "significant_strikes_attempted", "total_strikes_landed", "total_strikes_attempted", "takedowns_landed", "takedowns_attempted", "submission_attempts", "reversals", "control_time_seconds")
    return f"""SELECT fight_url, fighter_url, round, {', '.join(f'{_third(c)} AS {c}' for c in same)},
  {_third('significant_strikes_landed')} + CASE WHEN round = 1 AND fight_url LIKE '%10' THEN 1 ELSE 0 END AS significant_strikes_landed
FROM fight_totals {d.each(['1', '2', '3'], 'round')} WHERE fight_url NOT LIKE '%7'"""


def _breakdowns(d: Dialect) -> str:
    s = "significant_strikes_landed"
    parts = {"head": f"CAST(floor({s} / 2) AS INT)", "body": f"CAST(floor({s} / 4) AS INT)", "distance": f"CAST(floor({s} / 3) AS INT)", "clinch": f"CAST(floor({s} / 5) AS INT)"}
    parts["leg"] = f"({s} - {parts['head']} - {parts['body']})"
    parts["ground"] = f"({s} - {parts['distance']} - {parts['clinch']} + CASE WHEN fight_url LIKE '%11' THEN 1 ELSE 0 END)"
    shown = [f"{sql} AS {n}_landed, {sql} + CASE WHEN fight_url LIKE '%12' AND '{n}' = 'head' THEN -1 ELSE 2 END AS {n}_attempted" for n, sql in parts.items()]
    return f"SELECT fight_url, fighter_url, 0 AS round, {', '.join(shown)} FROM fight_totals"


#: In the order in which they build on each other.
TABLES: tuple[Part, ...] = (
    ("contests", _contests), ("fights", _fights), ("fighters", _fighters), ("fight_totals", _totals), ("round_stats", _rounds), ("sig_strike_breakdowns", _breakdowns),
)
