"""Order books, links, signals, scheduled captures and the scoreboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, report, stores
from ..plans.bouts import FROM_SALES
from ..plans.dialect import Duck
from ..sources import markets
from .base import Registry, tables

_r = Registry()
SALES = ("lineitem", "orders", "customer")
AS_OF = "2024-01-15 00:00:00"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with k + 1 raw levels a side around the mid, worst first."""
    e = tables(spark, sf_dir, "events")["events"]
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)) % 7
    mid = (100 + F.floor(F.col("value") * 19.6)).cast("long")
    level = lambda sign: F.transform(
        F.sequence(F.lit(0), k), lambda i: F.struct(((mid + sign * (5 + 3 * (k - i))) / 10000).alias("price"), (10 + i * 5).cast("double").alias("size"))
    )
    return e.select("event_id", F.col("user_id").cast("string").alias("token_id"), F.col("ts").alias("captured_at"), mid.alias("mid"), k.alias("k"), level(-1).alias("bids"), level(1).alias("asks"))


_BOOKS_SQL = """SELECT event_id, CAST(user_id AS VARCHAR) AS token_id, ts AS captured_at, 100 + CAST(floor(value * 19.6::DOUBLE) AS BIGINT) AS mid, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) % 7 AS k FROM events"""


def book_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = markets.snapshots(_books(spark, sf_dir), depth=3)
    shown = lambda side: F.array_join(F.transform(side, lambda x: F.concat_ws("@", F.round(x["price"] * 10000).cast("long").cast("string"), x["size"].cast("long").cast("string"))), ",")
    return good.select("event_id", shown("bids").alias("bids"), shown("asks").alias("asks"), F.round("mid_price", 9).alias("mid_price"), F.round("spread", 9).alias("spread"), "best_bid_size", "best_ask_size")


_r.add("book_topk", book_topk, f"""
WITH b AS ({_BOOKS_SQL}), l AS (SELECT *, [k - j FOR j IN range(0, least(k + 1, 3))] AS best FROM b WHERE mid - (5 + 3 * k) > 0 AND mid + (5 + 3 * k) < 10000)
SELECT event_id, array_to_string([CAST(mid - (5 + 3 * (k - i)) AS VARCHAR) || '@' || CAST(10 + i * 5 AS VARCHAR) FOR i IN best], ',') AS bids,
  array_to_string([CAST(mid + (5 + 3 * (k - i)) AS VARCHAR) || '@' || CAST(10 + i * 5 AS VARCHAR) FOR i IN best], ',') AS asks,
  round(mid / 10000.0::DOUBLE, 9) AS mid_price, round(10 / 10000.0::DOUBLE, 9) AS spread, (10 + k * 5)::DOUBLE AS best_bid_size, (10 + k * 5)::DOUBLE AS best_ask_size FROM l""")


def tick_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and mean mid of each five-minute tick."""
    rows = _books(spark, sf_dir).groupBy(F.window("captured_at", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("token_id").alias("tokens"), F.sum("mid").alias("mids"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("tick"), "n", "tokens", "mids")


_r.add("tick_cross_section", tick_cross_section, f"""WITH b AS ({_BOOKS_SQL})
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, captured_at), '%Y-%m-%d %H:%M:%S') AS tick, count(*) AS n, count(DISTINCT token_id) AS tokens, CAST(sum(mid) AS BIGINT) AS mids FROM b GROUP BY 1""")


def _market_side(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bouts, contestants with names, and markets that ask about every pair; each fifth misspells a name."""
    source = tables(spark, sf_dir, *SALES, "supplier")
    fights = FROM_SALES.then(("out", lambda d: "SELECT fight_url, a AS fighter_a_url, b AS fighter_b_url FROM bouts")).run(spark, source)
    name = F.concat(F.lit("Ácé Ñame-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(" Jr."))
    fighters = source["supplier"].where("s_suppkey % 23 <> 0").select(F.concat(F.lit("c"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("fighter_url"), name.alias("name"))
    short = lambda c: F.concat(F.lit("ACE NAME"), F.substring(c, 2, 9))
    pairs = fights.groupBy("fighter_a_url", "fighter_b_url").agg(F.min("fight_url").alias("f"))
    second = F.when(F.expr("cast(substr(f, 2) as bigint) % 5 = 0"), F.concat(F.lit("ACE NAM "), F.substring("fighter_b_url", 2, 9))).otherwise(short(F.col("fighter_b_url")))
    asked = pairs.select(F.concat(F.lit("t"), "f").alias("token_id"), F.concat(F.lit("UFC 310: Will "), short(F.col("fighter_a_url")), F.lit(" beat "), second, F.lit("?")).alias("question"))
    again = asked.where("cast(substr(token_id, 3) as bigint) % 3 = 0").select(F.concat("token_id", F.lit("x")).alias("token_id"), "question")
    return fights, fighters, asked.unionByName(again)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.resolve_links(*_market_side(spark, sf_dir))


_BOUTS_SQL = FROM_SALES.then(("out", lambda d: "SELECT 1")).text(Duck()).rsplit("SELECT 1", 1)[0].rstrip()
_r.add("links", links, f"""{_BOUTS_SQL},
fights AS (SELECT fight_url, a, b FROM bouts),
asked AS (SELECT a, b, min(fight_url) AS f FROM fights GROUP BY a, b HAVING CAST(substr(min(fight_url), 2) AS BIGINT) % 5 <> 0),
tokens AS (SELECT 't' || f AS token_id, a, b FROM asked UNION ALL SELECT 't' || f || 'x', a, b FROM asked WHERE CAST(substr(f, 2) AS BIGINT) % 3 = 0),
known AS (SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS c FROM supplier WHERE s_suppkey % 23 <> 0),
cand AS (SELECT f.fight_url, count(DISTINCT t.token_id) AS n, min(t.token_id) AS token FROM fights f JOIN tokens t ON (t.a = f.a AND t.b = f.b) OR (t.a = f.b AND t.b = f.a)
  WHERE f.a IN (SELECT c FROM known) AND f.b IN (SELECT c FROM known) GROUP BY f.fight_url)
SELECT f.fight_url, coalesce(c.token, '') AS token_id,
  CASE WHEN f.a NOT IN (SELECT c FROM known) OR f.b NOT IN (SELECT c FROM known) THEN 'INVALID_INPUT' WHEN c.n IS NULL THEN 'NO_CANDIDATE' WHEN c.n = 1 THEN 'MATCHED' ELSE 'MULTIPLE_CANDIDATES' END AS match_status,
  CASE WHEN c.n = 1 THEN 'AUTO_NAME' END AS match_method, CAST(coalesce(c.n, 0) AS INT) AS candidate_count
FROM fights f LEFT JOIN cand c ON c.fight_url = f.fight_url""")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a signal; a third without a known start."""
    e = tables(spark, sf_dir, "events")["events"]
    start = F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL '30' HOUR"))
    return e.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("signal_id"), F.col("user_id").cast("string").alias("token_id"), F.col("ts").alias("created_at"), start.alias("event_start_time"))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def snapshot_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.schedule(_signals(spark, sf_dir)).select("signal_id", "token_id", "scheduled_offset", _stamp("scheduled_at"), "status", "snapshot_id")


_SCHEDULE_SQL = """WITH s AS (SELECT 's' || CAST(event_id AS VARCHAR) AS signal_id, CAST(user_id AS VARCHAR) AS token_id, ts, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 30 HOUR END AS start FROM events),
sched AS (SELECT signal_id, token_id, o AS scheduled_offset, CASE o WHEN '1H' THEN ts + INTERVAL 1 HOUR WHEN '4H' THEN ts + INTERVAL 4 HOUR WHEN '24H' THEN ts + INTERVAL 24 HOUR ELSE start END AS due_at FROM s, unnest(['1H', '4H', '24H', 'FIGHT_TIME']) t(o))"""
_r.add("snapshot_schedule", snapshot_schedule, f"""{_SCHEDULE_SQL} SELECT signal_id, token_id, scheduled_offset, strftime(due_at, '%Y-%m-%d %H:%M:%S') AS scheduled_at,
CASE WHEN due_at IS NULL THEN 'SKIPPED' ELSE 'PENDING' END AS status, sha256(signal_id || '|' || scheduled_offset) AS snapshot_id FROM sched""")


def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = _books(spark, sf_dir).select("token_id", "captured_at", F.col("mid").alias("mid_price"))
    done = report.execute_due(report.schedule(_signals(spark, sf_dir)), books, AS_OF)
    return done.select("signal_id", "scheduled_offset", "status", _stamp("actual_captured_at"), F.col("mid_price").cast("double").alias("mid"))


_r.add("snapshot_asof", snapshot_asof, f"""{_SCHEDULE_SQL}, b AS ({_BOOKS_SQL}), due AS (SELECT * FROM sched WHERE due_at <= TIMESTAMP '{AS_OF}'),
hit AS (SELECT d.signal_id, d.scheduled_offset, min(b.captured_at) AS got FROM due d JOIN b ON b.token_id = d.token_id AND b.captured_at >= d.due_at AND b.captured_at <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2)
SELECT d.signal_id, d.scheduled_offset, CASE WHEN h.got IS NULL THEN 'MISSED' ELSE 'CAPTURED' END AS status, strftime(h.got, '%Y-%m-%d %H:%M:%S') AS actual_captured_at,
  CAST((SELECT max(mid) FROM b WHERE b.token_id = d.token_id AND b.captured_at = h.got) AS DOUBLE) AS mid
FROM due d LEFT JOIN hit h ON h.signal_id = d.signal_id AND h.scheduled_offset = d.scheduled_offset""")


def quote_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last value before it."""
    e = tables(spark, sf_dir, "events")["events"]
    right = e.select("user_id", "ts", F.floor(F.col("value") * 100).cast("long").alias("cents"))
    return asof.asof_join(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["cents"], strict=True).select("event_id", F.col("cents").cast("double").alias("cents"), _stamp("matched_at"))


_r.add("quote_asof", quote_asof, """WITH r AS (SELECT user_id, ts, max(CAST(floor(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2)
SELECT l.event_id, r.cents::DOUBLE AS cents, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS matched_at FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts""")


def stale_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token's last quote as of a time, its age, and whether it is over 30 minutes old."""
    last = _books(spark, sf_dir).where(F.col("captured_at") <= F.lit(AS_OF).cast("timestamp_ntz")).groupBy("token_id").agg(F.max("captured_at").alias("t"))
    age = F.floor((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.col("t").cast("timestamp"))) / 60)
    return last.select("token_id", age.cast("long").alias("age_minutes"), (age > 30).alias("stale"))


_r.add("stale_quotes", stale_quotes, f"""WITH b AS ({_BOOKS_SQL}), l AS (SELECT token_id, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(captured_at)))) / 60) AS BIGINT) AS age FROM b WHERE captured_at <= TIMESTAMP '{AS_OF}' GROUP BY token_id)
SELECT token_id, age AS age_minutes, age > 30 AS stale FROM l""")


def signal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New signals of a run, appended to a log that has some of them already; the first of a key stays."""
    s = _signals(spark, sf_dir).select("signal_id", "token_id", F.lit(2).alias("run"))
    twice = s.unionByName(s.withColumn("run", F.lit(3)))
    log = s.where("cast(token_id as int) % 4 = 0").withColumn("run", F.lit(1))
    return log.unionByName(stores.insert_ignore(log, twice, ["signal_id"], "run"))


_r.add("signal_log", signal_log, "SELECT 's' || CAST(event_id AS VARCHAR) AS signal_id, CAST(user_id AS VARCHAR) AS token_id, CASE WHEN user_id % 4 = 0 THEN 1 ELSE 2 END AS run FROM events")


def due_diligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each signal without one, from a stand-in for the outside service that fails on some."""
    s = _signals(spark, sf_dir).select("signal_id", F.col("token_id").cast("int").alias("token"))
    done = s.where("token % 4 = 0").select("signal_id")
    return stores.pending_calls(s, done, ["signal_id"], _ask, "signal_id string, status string, reason string, verdict string")


def _ask(row: dict) -> dict:
    if row["token"] % 7 == 0:
        raise RuntimeError("no answer")
    return {"verdict": "VETO" if row["token"] % 2 else "CONFIRM"}


_r.add("due_diligence", due_diligence, """SELECT 's' || CAST(event_id AS VARCHAR) AS signal_id, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN user_id % 7 = 0 THEN 'RuntimeError: no answer' END AS reason,
CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 2 = 1 THEN 'VETO' ELSE 'CONFIRM' END AS verdict FROM events WHERE user_id % 4 <> 0""")


def unresolved_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts whose market is open, by date of the event, for review."""
    fights, fighters, questions = _market_side(spark, sf_dir)
    rows = report.resolve_links(fights, fighters, questions).withColumn("reviewed_by", F.lit(None).cast("string"))
    days = FROM_SALES.then(("out", lambda d: "SELECT fight_url, CAST(event_date AS VARCHAR(10)) AS event_date FROM bouts")).run(spark, tables(spark, sf_dir, *SALES))
    return report.unresolved(rows).join(days, "fight_url").groupBy("event_date").agg(F.count("*").alias("n"), F.min("fight_url").alias("first_fight"))


_r.add("unresolved_by_date", unresolved_by_date, f"""{_BOUTS_SQL}, known AS (SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS c FROM supplier WHERE s_suppkey % 23 <> 0),
asked AS (SELECT a, b, min(fight_url) AS f FROM bouts GROUP BY a, b HAVING CAST(substr(min(fight_url), 2) AS BIGINT) % 5 <> 0),
held AS (SELECT least(a, b) AS x, greatest(a, b) AS y, sum(CASE WHEN CAST(substr(f, 2) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END) AS n FROM asked GROUP BY 1, 2)
SELECT CAST(o.event_date AS VARCHAR) AS event_date, count(*) AS n, min(o.fight_url) AS first_fight FROM bouts o LEFT JOIN held h ON h.x = least(o.a, o.b) AND h.y = greatest(o.a, o.b)
WHERE NOT (o.a IN (SELECT c FROM known) AND o.b IN (SELECT c FROM known) AND coalesce(h.n, 0) = 1) GROUP BY 1""")


def _verdicts(d) -> str:
    return "SELECT fight_url, CASE CAST(substr(fight_url, 2) AS BIGINT) % 3 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'QUALIFY' ELSE 'VETO' END AS verdict, CAST(substr(fight_url, 2) AS BIGINT) % 21 - 10 AS m, winner, a FROM bouts"


_VERDICTS = FROM_SALES.then(("verdicts", _verdicts))


def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _VERDICTS.then(("out", lambda d: "SELECT verdict, CAST(m AS DOUBLE) / 100 AS mismatch_at_signal, winner AS actual_winner_url, a AS signal_favored_url FROM verdicts")).run(spark, tables(spark, sf_dir, *SALES))
    out = report.scoreboard(report.resolved(rows))
    return out.select("verdict", "cnt", "correct", "incorrect", F.round("mean_mismatch", 9).alias("mean_mismatch"), F.round("win_rate", 9).alias("win_rate"))


def _score_sql(d) -> str:
    right = "CASE WHEN verdict = 'VETO' THEN NOT (winner = a) ELSE winner = a END"
    n = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"SELECT verdict, count(*) AS cnt, {n(right)} AS correct, {n('NOT (' + right + ')')} AS incorrect, round(avg(abs(m / 100.0::DOUBLE)), 9) AS mean_mismatch, round({n(right)} / count(*)::DOUBLE, 9) AS win_rate FROM verdicts GROUP BY verdict"


_r.add("scoreboard", scoreboard, _VERDICTS.then(("out", _score_sql)).text(Duck()))

QUERIES, SQL = _r.queries, _r.sql
