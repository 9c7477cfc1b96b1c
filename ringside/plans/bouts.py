"""Bouts: one row a contest with both sides' totals, the input of all replays.

``from_tables`` makes them from canonical tables (fights, events, fight_totals);
``from_sales`` from a star schema of orders, where two suppliers of an order are
its contestants. Both give the same columns.

tick: a whole number that orders events; contests of one event share it. Events
are few beside contests; they are numbered by one window over the event table
(or are dates, which number themselves).
"""

from __future__ import annotations

from .dialect import Dialect, Part, Plan, columns

STATS = ("kd", "sig_l", "sig_a", "tot_l", "tot_a", "td_l", "td_a", "sub", "rev", "ctrl")

#: Names of a totals row in the canonical tables, in the order of STATS. Fixed values.
TOTALS_COLUMNS = (
    "knockdowns", "significant_strikes_landed", "significant_strikes_attempted", "total_strikes_landed", "total_strikes_attempted",
    "takedowns_landed", "takedowns_attempted", "submission_attempts", "reversals", "control_time_seconds",
)


def seconds(d: Dialect) -> str:
    """Seconds fought: 300 for each full round, then the ending time. Whole
    numbers, so that sums and variances over them are exact."""
    m, s = d.try_int("split_part(ending_time, ':', 1)"), d.try_int("split_part(ending_time, ':', 2)")
    return f"CAST((ending_round - 1) * 300 + {m} * 60 + coalesce({s}, 0) AS BIGINT)"


def _timed(d: Dialect) -> str:
    return f"{seconds(d)} AS seconds, {seconds(d)} / CAST(60 AS DOUBLE) AS minutes"


def _lines(d: Dialect) -> str:
    return f"""SELECT l_orderkey, l_suppkey,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(CASE WHEN l_linestatus = 'F' AND l_quantity > 40 THEN 1 ELSE 0 END) AS INT) AS kd,
  CAST(sum(CAST(floor(l_quantity * (1 - l_discount)) AS BIGINT)) AS INT) AS sig_l,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS INT) AS sig_a,
  CAST(sum(CAST(floor(l_quantity * (1 - l_discount)) AS BIGINT) + 5) AS INT) AS tot_l,
  CAST(sum(CAST(l_quantity AS BIGINT) + 10) AS INT) AS tot_a,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) AS INT) AS td_l,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END) AS INT) AS td_a,
  CAST(sum(CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END) AS INT) AS sub,
  CAST(sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS INT) AS rev,
  CAST(sum(l_linenumber) * 10 AS INT) AS ctrl
FROM {d.dealt('lineitem', 'l_orderkey')} GROUP BY l_orderkey, l_suppkey"""


def _pairs(d: Dialect) -> str:
    picked = [f"{pick}({c}, l_suppkey) AS {side}_{c}" for side, pick in (("a", "min_by"), ("b", "max_by")) for c in ("cents", *STATS)]
    return f"""SELECT l_orderkey, min(l_suppkey) AS a_key, max(l_suppkey) AS b_key, {columns(picked)}
FROM lines GROUP BY l_orderkey HAVING count(*) >= 2"""


#: Weight classes of the market segments. Fixed values.
CLASSES = {"AUTOMOBILE": "Flyweight", "BUILDING": "Lightweight", "FURNITURE": "Welterweight", "HOUSEHOLD": "Middleweight", "MACHINERY": "Heavyweight"}


def competitor(key: str) -> str:
    return f"concat('c', lpad(CAST({key} AS VARCHAR(20)), 9, '0'))"


def _raw(d: Dialect) -> str:
    has = "o_orderkey % 11 <> 0"
    stats = [f"CASE WHEN {has} THEN p.{s}_{c} END AS {s}_{c}" for s in "ab" for c in STATS]
    segment = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())
    return f"""SELECT concat('b', lpad(CAST(o_orderkey AS VARCHAR(20)), 11, '0')) AS fight_url,
  concat('e', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20))) AS event_url,
  CAST(o_orderdate AS DATE) AS event_date,
  {competitor('p.a_key')} AS a, {competitor('p.b_key')} AS b,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' OR p.a_cents = p.b_cents THEN NULL
    WHEN p.a_cents > p.b_cents THEN {competitor('p.a_key')} ELSE {competitor('p.b_key')} END AS winner,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'KO/TKO' WHEN '2-HIGH' THEN 'Submission' WHEN '3-MEDIUM' THEN 'Decision - Unanimous'
    WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 1 THEN 'No Contest' ELSE 'Draw' END
    ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'TKO - Doctor''s Stoppage' WHEN o_orderkey % 3 = 0 THEN 'DQ' ELSE 'Decision - Split' END END AS method,
  CAST(1 + o_orderkey % (CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 3 END) AS INT) AS ending_round,
  concat(CAST(o_orderkey % 5 AS VARCHAR(20)), ':', lpad(CAST(o_orderkey % 60 AS VARCHAR(20)), 2, '0')) AS ending_time,
  CASE WHEN o_orderkey % 7 = 0 THEN '5 Rnd (5-5-5-5-5)' ELSE '3 Rnd (5-5-5)' END AS time_format,
  concat(CASE c_mktsegment {segment} ELSE c_mktsegment END, CASE WHEN o_orderkey % 50 = 0 THEN ' Title' ELSE '' END) AS weight_class,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(1 + o_orderkey % 14 AS INT) END AS bout_order,
  {has} AS has,
  {columns(stats)}
FROM pairs p JOIN {d.table('orders')} o ON p.l_orderkey = o.o_orderkey JOIN {d.table('customer')} c ON o.o_custkey = c.c_custkey"""


def _day(d: Dialect, column: str = "event_date") -> str:
    return d.days(column, "DATE '1970-01-01'")


def _sales_bouts(d: Dialect) -> str:
    """An event is a date here, so the day itself orders the events."""
    return f"SELECT *, CAST({_day(d)} AS INT) AS tick, {_day(d)} AS day, {_timed(d)} FROM raw_bouts"


FROM_SALES = Plan((("lines", _lines), ("pairs", _pairs), ("raw_bouts", _raw), ("bouts", _sales_bouts)))


def _joined(d: Dialect) -> str:
    stats = [f"t{s}.{long} AS {s}_{short}" for s in "ab" for short, long in zip(STATS, TOTALS_COLUMNS, strict=True)]
    return f"""SELECT f.fight_url, f.event_url, e.date AS event_date, f.fighter_a_url AS a, f.fighter_b_url AS b, f.winner_url AS winner, f.method,
  f.ending_round, f.ending_time, f.time_format, coalesce(f.weight_class, '') AS weight_class, f.bout_order,
  ta.fight_url IS NOT NULL AND tb.fight_url IS NOT NULL AS has, {columns(stats)}
FROM {d.table('fights')} f JOIN {d.table('events')} e ON f.event_url = e.event_url
LEFT JOIN {d.table('fight_totals')} ta ON ta.fight_url = f.fight_url AND ta.fighter_url = f.fighter_a_url
LEFT JOIN {d.table('fight_totals')} tb ON tb.fight_url = f.fight_url AND tb.fighter_url = f.fighter_b_url"""


def _numbered(d: Dialect) -> str:
    return f"SELECT event_url, CAST(dense_rank() OVER (ORDER BY date, event_url) AS INT) AS tick FROM {d.table('events')}"


def _table_bouts(d: Dialect) -> str:
    return f"SELECT r.*, t.tick, {_day(d)} AS day, {_timed(d)} FROM raw_bouts r JOIN ticks t ON r.event_url = t.event_url"


FROM_TABLES = Plan((("raw_bouts", _joined), ("ticks", _numbered), ("bouts", _table_bouts)))


def _fighters_sales(d: Dialect) -> str:
    return f"""SELECT {competitor('s_suppkey')} AS fighter, CAST(160 + s_suppkey % 40 AS DOUBLE) AS height_cm,
  CASE WHEN s_suppkey % 17 <> 0 THEN CAST(155 + s_suppkey % 40 + s_nationkey % 15 AS DOUBLE) END AS reach_cm,
  CASE s_nationkey % 5 WHEN 0 THEN 'Orthodox' WHEN 1 THEN 'Southpaw' WHEN 2 THEN 'Switch' WHEN 3 THEN NULL ELSE 'Orthodox' END AS stance,
  CASE WHEN s_suppkey % 19 <> 0 THEN CAST(DATE '1960-01-01' + CAST(s_suppkey % 7000 AS INT) AS DATE) END AS dob
FROM {d.table('supplier')}"""


def _fighters_tables(d: Dialect) -> str:
    return f"SELECT fighter_url AS fighter, height_cm, reach_cm, stance, date_of_birth AS dob FROM {d.table('fighters')}"


FIGHTERS_FROM_SALES: Part = ("profiles", _fighters_sales)
FIGHTERS_FROM_TABLES: Part = ("profiles", _fighters_tables)
