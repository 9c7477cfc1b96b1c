"""Point-in-time replay as windows: every row sees only earlier events.

Each bout gives two rows, one a side. What a contestant's record was before an
event is read by RANGE frames that end one tick earlier, so bouts of the same
event never see each other, whatever their number. The state after the last
earlier bout (streak, rolling figures, class record) is computed bout by bout in
(tick, fight_url) order with ROWS frames and carried as the greatest earlier
struct that starts with (tick, fight_url).
"""

from __future__ import annotations

from collections.abc import Collection

from .bouts import STATS
from .dialect import Dialect, Part, columns

ROLLING = 10
#: Rates of one bout and how they come from own (o_) and opponent (p_) totals.
RATES = {
    "sig_strikes_per_min": "o_sig_l / nullif(minutes, 0)",
    "sig_strikes_absorbed_per_min": "p_sig_l / nullif(minutes, 0)",
    "striking_accuracy_pct": "o_sig_l / nullif(CAST(o_sig_a AS DOUBLE), 0)",
    "striking_defense_pct": "(p_sig_a - p_sig_l) / nullif(CAST(p_sig_a AS DOUBLE), 0)",
    "td_per_15min": "o_td_l * CAST(15 AS DOUBLE) / nullif(minutes, 0)",
    "td_accuracy_pct": "o_td_l / nullif(CAST(o_td_a AS DOUBLE), 0)",
    "td_defense_pct": "(p_td_a - p_td_l) / nullif(CAST(p_td_a AS DOUBLE), 0)",
    "sub_attempts_per_15min": "o_sub * CAST(15 AS DOUBLE) / nullif(minutes, 0)",
    "knockdown_rate": "o_kd / nullif(CAST(o_sig_a AS DOUBLE), 0)",
    "damage_ratio": "o_sig_l / nullif(CAST(p_sig_l AS DOUBLE), 0)",
    "grappling_dominance": "(o_td_l + o_ctrl) / nullif(CAST(p_td_l + p_ctrl AS DOUBLE), 0)",
    "control_time_per_fight": "CAST(o_ctrl AS DOUBLE)",
}
VARIED = ("sig_strikes_per_min", "sig_strikes_absorbed_per_min", "striking_accuracy_pct", "td_per_15min", "damage_ratio")


def _sides(d: Dialect) -> str:
    pick = lambda c: f"CASE WHEN side = 0 THEN a_{c} ELSE b_{c} END AS o_{c}, CASE WHEN side = 0 THEN b_{c} ELSE a_{c} END AS p_{c}"
    return f"""SELECT fight_url, event_url, event_date, tick, day, side,
  CASE WHEN side = 0 THEN a ELSE b END AS fighter, CASE WHEN side = 0 THEN b ELSE a END AS opponent,
  winner, method, upper(method) AS m, ending_round, time_format, weight_class, bout_order, seconds, minutes, has,
  {columns(pick(c) for c in STATS)}
FROM bouts {d.sides('side')}"""


def _flags(d: Dialect) -> str:
    won, lost = "winner IS NOT NULL AND winner = fighter", "winner IS NOT NULL AND winner <> fighter"
    ko, sub = "m LIKE '%KO%' AND m NOT LIKE '%COULD NOT%'", "m LIKE '%SUBMISSION%'"
    flag = lambda cond, name: f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {name}"
    return f"""SELECT *,
  {flag(won, 'won')}, {flag(lost, 'lost')},
  {flag("winner IS NULL AND m LIKE '%DRAW%'", 'drew')}, {flag("winner IS NULL AND m NOT LIKE '%DRAW%'", 'nc')},
  {flag(f'{won} AND ({ko})', 'won_ko')}, {flag(f'{won} AND NOT ({ko}) AND {sub}', 'won_sub')},
  {flag(f"{won} AND NOT ({ko}) AND NOT {sub} AND m LIKE '%DECISION%'", 'won_dec')},
  {flag(f'{lost} AND ({ko})', 'lost_ko')}, {flag(f'{lost} AND NOT ({ko}) AND {sub}', 'lost_sub')},
  {flag(f'{won} AND ending_round = 1 AND (({ko}) OR {sub})', 'won_r1')}, {flag(f'{lost} AND ending_round = 1 AND (({ko}) OR {sub})', 'lost_r1')},
  {flag("lower(weight_class) LIKE '%title%'", 'title')}, {flag("trim(time_format) LIKE '5%'", 'five')}
FROM sides"""


def _posted(d: Dialect) -> str:
    """After each bout, in order within the contestant."""
    rates = [f"{sql} AS r_{name}" for name, sql in RATES.items()]
    return f"""SELECT *, {columns(rates)},
  first_value(weight_class) OVER seq AS first_class,
  lag(weight_class) OVER seq_all AS class_before,
  CAST(sum(won + lost) OVER seq AS BIGINT) AS decided,
  CAST(count(*) OVER (PARTITION BY fighter, weight_class ORDER BY tick, fight_url ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS class_n,
  CAST(sum(won) OVER (PARTITION BY fighter, weight_class ORDER BY tick, fight_url ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS class_won,
  CAST(count(*) OVER (PARTITION BY fighter ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_upto_day
FROM {d.part_dealt('flags', 'fighter')}
WINDOW seq_all AS (PARTITION BY fighter ORDER BY tick, fight_url),
  seq AS (PARTITION BY fighter ORDER BY tick, fight_url ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _rolled(d: Dialect) -> str:
    seq = "(PARTITION BY fighter ORDER BY tick, fight_url ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    avgs = [f"avg(r_{r}) OVER roll AS avg_{r}" for r in RATES]
    variances = [f"CASE WHEN count(r_{r}) OVER roll >= 2 THEN var_pop(r_{r}) OVER roll END AS var_{r}" for r in VARIED]
    return f"""SELECT *, {columns(avgs, variances)},
  CAST(sum(seconds) OVER roll AS DOUBLE) / nullif(count(seconds) OVER roll, 0) AS avg_seconds,
  CASE WHEN count(*) OVER roll >= 3 THEN CAST(count(seconds) OVER roll * sum(seconds * seconds) OVER roll - sum(seconds) OVER roll * sum(seconds) OVER roll AS DOUBLE)
    / nullif(count(seconds) OVER roll * count(seconds) OVER roll, 0) END AS var_seconds,
  avg(CAST(o_td_a + o_ctrl AS DOUBLE)) OVER roll AS avg_grapple,
  coalesce(max(CASE WHEN won = 1 THEN decided END) OVER {seq}, 0) AS win_at,
  coalesce(max(CASE WHEN lost = 1 THEN decided END) OVER {seq}, 0) AS loss_at,
  CAST(sum(CASE WHEN weight_class = first_class THEN 1 ELSE 0 END) OVER {seq} AS BIGINT) AS first_n,
  CAST(sum(CASE WHEN weight_class = first_class THEN won ELSE 0 END) OVER {seq} AS BIGINT) AS first_won,
  avg(CAST(won AS DOUBLE)) OVER (PARTITION BY fighter ORDER BY tick, fight_url ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS won_last3,
  avg(CAST(won AS DOUBLE)) OVER (PARTITION BY fighter ORDER BY tick, fight_url ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS won_last5,
  CAST(sum(CASE WHEN class_before IS NOT NULL AND weight_class <> class_before THEN 1 ELSE 0 END) OVER {seq} AS BIGINT) AS moves
FROM posted
WINDOW roll AS (PARTITION BY fighter, has ORDER BY tick, fight_url ROWS BETWEEN {ROLLING - 1} PRECEDING AND CURRENT ROW)"""


SUMS = {
    "fights": "1", "wins": "won", "losses": "lost", "draws": "drew", "no_contests": "nc", "ko_wins": "won_ko", "submission_wins": "won_sub",
    "decision_wins": "won_dec", "finished_by_ko": "lost_ko", "finished_by_sub": "lost_sub", "round_one_finishes": "won_r1",
    "finished_round_one": "lost_r1", "title_fights": "title", "five_round_fights": "five", "five_round_wins": "five * won",
}


def _prior(d: Dialect, carried: Collection[str] | None = None) -> str:
    pack = lambda **fields: d.pack(**{k: v for k, v in fields.items() if carried is None or k in carried or k in ("tick", "fight_url")})
    sums = [f"CAST(coalesce(sum({sql}) OVER prior, 0) AS BIGINT) AS {name}" for name, sql in SUMS.items()]
    last = pack(
        tick="tick", fight_url="fight_url", day="event_date", method="method", klass="weight_class", class_n="class_n", class_won="class_won",
        first_class="first_class", first_n="first_n", first_won="first_won", moves="moves", won_last3="won_last3", won_last5="won_last5",
        streak="win_at - loss_at",  # decisive bouts since the last of the other kind
    )
    rolling = pack(
        tick="tick", fight_url="fight_url", **{f"avg_{r}": f"avg_{r}" for r in RATES}, **{f"var_{r}": f"var_{r}" for r in VARIED},
        avg_seconds="avg_seconds", var_seconds="var_seconds", avg_grapple="avg_grapple",
    )
    meeting = pack(tick="tick", fight_url="fight_url", day="event_date", winner="winner", method="method", round="ending_round", upto="n_upto_day")
    within = lambda days: f"CAST(coalesce(sum(1) OVER prior, 0) - coalesce(sum(1) OVER (PARTITION BY fighter ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND {days} PRECEDING), 0) AS BIGINT)"
    return f"""SELECT fight_url, event_url, event_date, tick, day, side, fighter, opponent, winner, weight_class, bout_order,
  {columns(sums)},
  min(event_date) OVER prior AS debut_date,
  min(CASE WHEN title = 1 AND won = 1 THEN event_date END) OVER prior AS first_title_date,
  {within(365)} AS fights_12mo, {within(1095)} AS fights_3yr, {within(1825)} AS fights_5yr,
  max({last}) OVER prior AS last_state,
  max(CASE WHEN has THEN {rolling} END) OVER prior AS rolling,
  min({meeting}) OVER (PARTITION BY fighter, opponent ORDER BY tick RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS meeting
FROM rolled
WINDOW prior AS (PARTITION BY fighter ORDER BY tick RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


REPLAY: tuple[Part, ...] = (("sides", _sides), ("flags", _flags), ("posted", _posted), ("rolled", _rolled), ("prior_state", _prior))


def replay(carried: Collection[str]) -> tuple[Part, ...]:
    """``REPLAY`` with these fields only in the carried states."""
    return (*REPLAY[:-1], ("prior_state", lambda d: _prior(d, carried)))


#: Enough for plain records: no rolling figures or carried states.
RECORD_ONLY: tuple[Part, ...] = (("sides", _sides), ("flags", _flags))
