"""Data-quality invariants over the canonical tables.

They catch what can't be, never what is missing. Each invariant scans a stats
table once: rows without a finding are filtered at the scan, and only the rest
are dated and their column checks unpivoted. All findings have the same five columns: table_name, row_key,
reason_code, detail, event_date (as text, NULL where none is known).
"""

from __future__ import annotations

from .dialect import Dialect, Part, columns

PAIRS = ("significant_strikes", "total_strikes", "takedowns")
SPLITS = ("head", "body", "leg", "distance", "clinch", "ground")
COUNTS = (
    "knockdowns", "significant_strikes_landed", "significant_strikes_attempted", "total_strikes_landed", "total_strikes_attempted",
    "takedowns_landed", "takedowns_attempted", "submission_attempts", "reversals", "control_time_seconds",
)
#: Columns checked for negative counts by table, and those that rounds must sum to. Fixed values.
COUNT_COLUMNS = {
    "fight_totals": COUNTS,
    "round_stats": tuple(c for c in COUNTS if not c.startswith("total_strikes")),
    "sig_strike_breakdowns": tuple(f"{s}_{k}" for s in SPLITS for k in ("landed", "attempted")),
}
SUM_COLUMNS = ("knockdowns", "significant_strikes_landed", "significant_strikes_attempted", "takedowns_landed", "takedowns_attempted", "submission_attempts", "reversals")
#: Plausible ranges of measurements, the first event, and how far ahead events may be announced. Fixed values.
RANGES = {"height_cm": (120, 230), "reach_cm": (120, 250), "weight_kg": (40, 360)}
FIRST_EVENT = "1993-11-12"
AHEAD_DAYS = 400
ROUND_SECONDS = 300
STATS_TABLES = ("fight_totals", "round_stats", "sig_strike_breakdowns")


def _text(x: str) -> str:
    return f"CAST({x} AS VARCHAR(200))"


def _key(table: str, alias: str = "t") -> str:
    parts = [f"{alias}.fight_url", f"{alias}.fighter_url"] + ([f"{alias}.round"] if table != "fight_totals" else [])
    return " || '|' || ".join(f"coalesce({_text(p)}, 'None')" for p in parts)


def _found(table: str, key: str, reason: str, detail: str, day: str | None) -> str:
    shown = "CAST(NULL AS VARCHAR(10))" if day is None else f"CAST({day} AS VARCHAR(10))"
    return f"'{table}' AS table_name, {key} AS row_key, '{reason}' AS reason_code, {detail} AS detail, {shown} AS event_date"


def _dated(d: Dialect, table: str) -> str:
    return f"{d.table(table)} t JOIN {d.table('fights')} f ON t.fight_url = f.fight_url JOIN {d.table('contests')} e ON f.event_url = e.event_url"


def landed_gt_attempted(d: Dialect) -> str:
    out = []
    for table in STATS_TABLES:
        names = SPLITS if table == "sig_strike_breakdowns" else PAIRS
        items = [d.pack(n=f"'{n}'", l=f"t.{n}_landed", a=f"t.{n}_attempted") for n in names]
        detail = f"c.n || '_landed=' || {_text('c.l')} || ' > ' || c.n || '_attempted=' || {_text('c.a')}"
        some = " OR ".join(f"t.{n}_landed > t.{n}_attempted" for n in names)
        out.append(
            f"SELECT {_found(table, 'row_key', 'LANDED_GT_ATTEMPTED', detail, 'event_day')} FROM (SELECT {_key(table)} AS row_key, e.date AS event_day, c "
            f"FROM {_dated(d, table)} {d.each(items, 'c')} WHERE {some}) x WHERE c.l > c.a"
        )
    return "\nUNION ALL\n".join(out)


def negative_stat(d: Dialect) -> str:
    out = []
    for table in STATS_TABLES:
        items = [d.pack(n=f"'{n}'", v=f"t.{n}") for n in COUNT_COLUMNS[table]]
        detail = f"c.n || '=' || {_text('c.v')} || ' is negative'"
        some = " OR ".join(f"t.{n} < 0" for n in COUNT_COLUMNS[table])
        out.append(
            f"SELECT {_found(table, 'row_key', 'NEGATIVE_STAT', detail, 'event_day')} FROM (SELECT {_key(table)} AS row_key, e.date AS event_day, c "
            f"FROM {_dated(d, table)} {d.each(items, 'c')} WHERE {some}) x WHERE c.v < 0"
        )
    return "\nUNION ALL\n".join(out)


def round_sum_mismatch(d: Dialect) -> str:
    sums = [f"CAST(sum(r.{c}) AS BIGINT) AS r_{c}, any_value(t.{c}) AS t_{c}" for c in SUM_COLUMNS]
    differ = " OR ".join(f"r_{c} <> t_{c}" for c in SUM_COLUMNS)
    pieces = ", ".join(f"CASE WHEN r_{c} <> t_{c} THEN '{c}: rounds=' || {_text(f'r_{c}')} || ' totals=' || {_text(f't_{c}')} END" for c in SUM_COLUMNS)
    return f"""SELECT {_found('round_stats', "s.fight_url || '|' || s.fighter_url", 'ROUND_SUM_MISMATCH', f"concat_ws('; ', {pieces})", 'e.date')}
FROM (SELECT r.fight_url, r.fighter_url, {columns(sums)}
  FROM {d.table('round_stats')} r JOIN {d.table('fight_totals')} t ON r.fight_url = t.fight_url AND r.fighter_url = t.fighter_url
  GROUP BY r.fight_url, r.fighter_url) s
JOIN {d.table('fights')} f ON s.fight_url = f.fight_url JOIN {d.table('contests')} e ON f.event_url = e.event_url WHERE {differ}"""


def breakdown_mismatch(d: Dialect) -> str:
    a, b = "t.head_landed + t.body_landed + t.leg_landed", "t.distance_landed + t.clinch_landed + t.ground_landed"
    detail = f"'target split=' || {_text(a)} || ' != position split=' || {_text(b)}"
    return f"SELECT {_found('sig_strike_breakdowns', _key('sig_strike_breakdowns'), 'BREAKDOWN_PARTITION_MISMATCH', detail, 'e.date')} FROM {_dated(d, 'sig_strike_breakdowns')} WHERE {a} <> {b}"


def orphan_row(d: Dialect) -> str:
    orphan = lambda table, key, parent, col, why: (
        f"SELECT {_found(table, key, 'ORPHAN_ROW', chr(39) + why + chr(39), None)} FROM {d.table(table)} t LEFT JOIN {d.table(parent)} p ON t.{col} = p.{col} WHERE p.{col} IS NULL"
    )
    out = [orphan("fights", "t.fight_url", "contests", "event_url", "event_url not in events")]
    out += [orphan(t, "t.fight_url || '|' || t.fighter_url", "fights", "fight_url", "fight_url not in fights") for t in STATS_TABLES]
    return "\nUNION ALL\n".join(out)


def _fight_check(d: Dialect, reason: str, detail: str, where: str) -> str:
    return f"SELECT {_found('fights', 't.fight_url', reason, detail, 'e.date')} FROM {d.table('fights')} t JOIN {d.table('contests')} e ON t.event_url = e.event_url WHERE {where}"


def self_fight(d: Dialect) -> str:
    return _fight_check(d, "SELF_FIGHT", "'fighter_a_url == fighter_b_url'", "t.fighter_a_url = t.fighter_b_url")


def winner_not_in_fight(d: Dialect) -> str:
    return _fight_check(d, "WINNER_NOT_IN_FIGHT", "'winner_url=' || t.winner_url || ' is neither participant'", "t.winner_url IS NOT NULL AND t.winner_url NOT IN (t.fighter_a_url, t.fighter_b_url)")


def ending_round_invalid(d: Dialect) -> str:
    rounds = d.try_int("substr(t.time_format, 1, 1)")
    detail = f"'ending_round=' || {_text('t.ending_round')} || ' outside schedule ''' || t.time_format || ''''"
    if d.name == "spark":
        detail = f"'ending_round=' || {_text('t.ending_round')} || ' outside schedule ' || chr(39) || t.time_format || chr(39)"
    return _fight_check(d, "ENDING_ROUND_INVALID", detail, f"{rounds} IS NOT NULL AND t.time_format NOT LIKE '%OT%' AND (t.ending_round < 1 OR t.ending_round > {rounds})")


def measurement_out_of_range(d: Dialect) -> str:
    items = [d.pack(n=f"'{n}'", v=f"t.{n}", lo=str(lo), hi=str(hi)) for n, (lo, hi) in RANGES.items()]
    detail = f"c.n || '=' || {_text('c.v')} || ' outside [' || {_text('c.lo')} || ', ' || {_text('c.hi')} || ']'"
    some = " OR ".join(f"t.{n} < {lo} OR t.{n} > {hi}" for n, (lo, hi) in RANGES.items())
    last = f"""SELECT fighter_url, max(e.date) AS last_day FROM (SELECT CASE WHEN side = 0 THEN fighter_a_url ELSE fighter_b_url END AS fighter_url, event_url FROM {d.table('fights')} {d.sides('side')}) x
  JOIN {d.table('contests')} e ON x.event_url = e.event_url GROUP BY fighter_url"""
    return f"""SELECT {_found('fighters', 'y.fighter_url', 'MEASUREMENT_OUT_OF_RANGE', detail, 'l.last_day')}
FROM (SELECT t.fighter_url, c FROM {d.table('fighters')} t {d.each(items, 'c')} WHERE {some}) y LEFT JOIN ({last}) l ON y.fighter_url = l.fighter_url
WHERE c.v IS NOT NULL AND (c.v < c.lo OR c.v > c.hi)"""


def event_date_out_of_range(today: str):
    def sql(d: Dialect) -> str:
        late = f"CAST(DATE '{today}' + INTERVAL '{AHEAD_DAYS}' DAY AS DATE)"
        detail = f"'event date ' || CAST(t.date AS VARCHAR(10)) || ' outside [{FIRST_EVENT}, ' || CAST({late} AS VARCHAR(10)) || ']'"
        return f"SELECT {_found('events', 't.event_url', 'EVENT_DATE_OUT_OF_RANGE', detail, 't.date')} FROM {d.table('contests')} t WHERE t.date < DATE '{FIRST_EVENT}' OR t.date > {late}"

    return sql


def control_time_exceeds_fight(d: Dialect) -> str:
    fought = f"((f.ending_round - 1) * {ROUND_SECONDS} + {d.try_int('''split_part(f.ending_time, ':', 1)''')} * 60 + {d.try_int('''split_part(f.ending_time, ':', 2)''')})"
    detail = f"'control_time_seconds=' || {_text('t.control_time_seconds')} || ' > fight duration ' || {_text(fought)} || 's'"
    return f"SELECT {_found('fight_totals', _key('fight_totals'), 'CONTROL_TIME_EXCEEDS_FIGHT', detail, 'e.date')} FROM {_dated(d, 'fight_totals')} WHERE f.time_format LIKE '%(5-5-5%' AND t.control_time_seconds > {fought}"


def invariants(today: str) -> dict:
    """Name -> SQL of each of the eleven; ``today`` bounds announced events."""
    return {
        "landed_gt_attempted": landed_gt_attempted, "negative_stat": negative_stat, "round_sum_mismatch": round_sum_mismatch,
        "breakdown_partition_mismatch": breakdown_mismatch, "orphan_row": orphan_row, "self_fight": self_fight, "winner_not_in_fight": winner_not_in_fight,
        "ending_round_invalid": ending_round_invalid, "measurement_out_of_range": measurement_out_of_range,
        "event_date_out_of_range": event_date_out_of_range(today), "control_time_exceeds_fight": control_time_exceeds_fight,
    }


def all_findings(today: str) -> Part:
    return "violations", lambda d: "\nUNION ALL\n".join(f"SELECT * FROM (\n{sql(d)}\n) v{i}" for i, sql in enumerate(invariants(today).values()))


#: One row a (table, key, reason): the first finding by its detail.
QUARANTINE: Part = (
    "quarantine",
    lambda d: "SELECT table_name, row_key, reason_code, min(detail) AS detail, min(event_date) AS event_date FROM violations GROUP BY table_name, row_key, reason_code",
)


def era_report(start: str) -> Part:
    """One row: counts by era, and whether the label era is clean."""
    n = lambda cond: f"CAST(count(CASE WHEN {cond} THEN 1 END) AS BIGINT)"
    late, early, none = f"event_date >= '{start}'", f"event_date < '{start}'", "event_date IS NULL"
    return "report", lambda d: (
        f"SELECT '{start}' AS label_start_date, count(*) AS total_violations, {n(late)} AS label_universe_violations, {n(early)} AS pre_cutoff_violations, "
        f"{n(none)} AS undated_violations, {n(late)} = 0 AND {n(none)} = 0 AS passed FROM violations"
    )
