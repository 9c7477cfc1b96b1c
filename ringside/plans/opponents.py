"""Common opponents: whom both contestants of a bout met before.

Histories are reduced to (bout, side, opponent) where they are joined (the
contestant is one of the keys, so nothing is dealt again), before the two sides
are joined on the shared opponent, so the join's size is the number of shared opponents.
Shared means met by both within three years before the bout; win rates count all
earlier bouts against the shared set. Quality comes from an injected snapshot
(fighter, elo, pagerank); who isn't in it has 1500 and 0.
"""

from __future__ import annotations

from .dialect import Dialect, Part, difference

YEARS, DECAY = 3, 0.4


def _met(d: Dialect) -> str:
    cutoff = d.shifted_years("c.event_date", -YEARS)
    return f"""SELECT c.fight_url, c.side, c.event_date, c.tick, h.opponent AS opp,
  max(CASE WHEN h.event_date >= {cutoff} THEN h.event_date END) AS last_day, CAST(sum(h.won) AS BIGINT) AS won, CAST(sum(h.won + h.lost) AS BIGINT) AS decided
FROM flags c JOIN flags h ON h.fighter = c.fighter AND h.tick < c.tick
WHERE h.opponent <> c.opponent GROUP BY c.fighter, c.fight_url, c.side, c.event_date, c.tick, h.opponent
HAVING max(CASE WHEN h.event_date >= {cutoff} THEN h.event_date END) IS NOT NULL"""


def _recency(d: Dialect) -> str:
    decay = lambda day: f"exp(-CAST({DECAY} AS DOUBLE) * ({d.days('a.event_date', day)} / CAST(365.25 AS DOUBLE)))"
    return f"({decay('a.last_day')} + {decay('b.last_day')}) / 2"


def _unweighed(d: Dialect) -> str:
    return f"""SELECT a.fight_url, a.tick, a.opp, {_recency(d)} AS recency, a.won AS won_a, a.decided AS decided_a, b.won AS won_b, b.decided AS decided_b
FROM met a JOIN met b ON a.fight_url = b.fight_url AND a.opp = b.opp AND a.side = 0 AND b.side = 1"""


def _shared(d: Dialect) -> str:
    return f"""SELECT a.fight_url, a.opp,
  (CASE WHEN coalesce(q.elo, 1500) > 1000 THEN CAST(0.5 AS DOUBLE) * (coalesce(q.elo, CAST(1500 AS DOUBLE)) - 1000) / 1000 ELSE 0 END
    + CAST(0.5 AS DOUBLE) * coalesce(q.pagerank, CAST(0 AS DOUBLE))) * {_recency(d)} AS weight,
  a.won AS won_a, a.decided AS decided_a, b.won AS won_b, b.decided AS decided_b
FROM met a JOIN met b ON a.fight_url = b.fight_url AND a.opp = b.opp AND a.side = 0 AND b.side = 1
LEFT JOIN quality q ON q.fighter = a.opp"""


def _common(d: Dialect) -> str:
    score = lambda s: f"sum(weight * coalesce(won_{s} / nullif(CAST(decided_{s} AS DOUBLE), 0), 0))"
    rate = lambda s: f"coalesce(sum(won_{s}) / nullif(CAST(sum(decided_{s}) AS DOUBLE), 0), 0)"
    return f"""SELECT b.fight_url, CAST(coalesce(n, 0) AS INT) AS n_common_opponents, round(sa, 6) AS common_opp_score_a, round(sb, 6) AS common_opp_score_b,
  {difference('sa - sb', 6)} AS common_opp_score_delta, round(ra, 6) AS common_opp_a_win_rate, round(rb, 6) AS common_opp_b_win_rate
FROM bouts b LEFT JOIN (SELECT fight_url, count(*) AS n, {score('a')} AS sa, {score('b')} AS sb, {rate('a')} AS ra, {rate('b')} AS rb FROM shared GROUP BY fight_url) s
ON b.fight_url = s.fight_url"""


NO_QUALITY: Part = ("quality", lambda d: "SELECT CAST(NULL AS VARCHAR(20)) AS fighter, CAST(NULL AS DOUBLE) AS elo, CAST(NULL AS DOUBLE) AS pagerank")
#: Shared opponents without their quality, for ``operators.opponents``.
UNWEIGHED: tuple[Part, ...] = (("met", _met), ("unweighed", _unweighed))
COMMON: tuple[Part, ...] = (("met", _met), ("shared", _shared), ("common", _common))
