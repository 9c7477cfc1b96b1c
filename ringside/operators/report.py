"""Market report: links of bouts and markets, scheduled captures, scoreboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from .asof import asof_join

#: Hours after a signal at which quotes are captured again. Fixed values.
OFFSETS = {"1H": 1, "4H": 4, "24H": 24}
FIGHT_TIME = "FIGHT_TIME"
QUOTES = ("mid_price", "best_bid", "best_ask", "best_bid_size", "best_ask_size")


def _holding(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(token_id, fighter_url) of every question q that holds a canonical name,
    wherever it begins.

    A question's pieces of the lengths that names have meet whole names by
    equality, so no question is compared with every name and no key is hotter
    than a name is asked about. The lengths are few: as many at most as the longest
    name has characters."""
    lengths = [r[0] for r in names.select(F.length("canonical")).distinct().collect()]
    fits = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("q"))
    cut = F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length("q") - n + 1), lambda i: F.substring(F.col("q"), i, n)))
    pieces = asked.select("token_id", F.explode(F.array_distinct(F.flatten(cut))).alias("canonical"))
    return pieces.join(names, "canonical").select("token_id", "fighter_url").distinct()


def resolve_links(fights: DataFrame, fighters: DataFrame, questions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """fight_url, token_id, match_status, match_method, candidate_count.

    A market is a candidate where its lower-cased question holds both canonical
    names. Names are first found in questions, by equality of pieces, and bouts then
    meet their markets by equality on both contestants. Existing links
    stay. Without any question every bout is MISSING_SNAPSHOT; without a name on
    file INVALID_INPUT, and so is an empty canonical name, which every question
    would hold. Of several candidates the least token is shown.
    """
    names = fighters.select(F.col("fighter_url"), normalize_name(F.col("name")).alias("canonical")).where("canonical <> ''")
    asked = questions.where("question is not null").select("token_id", F.lower("question").alias("q")).distinct()
    held = _holding(asked, names)
    a = held.select("token_id", F.col("fighter_url").alias("fighter_a_url"))
    b = held.select("token_id", F.col("fighter_url").alias("fighter_b_url"))
    pairs = a.join(b, "token_id")  # a question holds a few names
    found = fights.select("fight_url", "fighter_a_url", "fighter_b_url").join(pairs, ["fighter_a_url", "fighter_b_url"])
    found = found.groupBy("fight_url").agg(F.count_distinct("token_id").alias("n"), F.min("token_id").alias("token"))
    known = names.select("fighter_url", F.lit(True).alias("_ok"))
    rows = (
        fights.select("fight_url", "fighter_a_url", "fighter_b_url")
        .join(known.select(F.col("fighter_url").alias("fighter_a_url"), F.col("_ok").alias("_a")), "fighter_a_url", "left")
        .join(known.select(F.col("fighter_url").alias("fighter_b_url"), F.col("_ok").alias("_b")), "fighter_b_url", "left")
        .join(found, "fight_url", "left")
    )
    no_snapshot = questions.limit(1).isEmpty()
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "INVALID_INPUT").when(F.lit(no_snapshot), "MISSING_SNAPSHOT")
        .when(n == 0, "NO_CANDIDATE").when(n == 1, "MATCHED").otherwise("MULTIPLE_CANDIDATES")
    )
    out = rows.select(
        "fight_url", F.when(n > 0, F.col("token")).otherwise("").alias("token_id"), status.alias("match_status"),
        F.when(status == "MATCHED", "AUTO_NAME").alias("match_method"), n.cast("int").alias("candidate_count"),
    )
    if existing is None:
        return out
    kept = existing.select(*out.columns)
    return kept.unionByName(out.join(kept.select("fight_url"), "fight_url", "left_anti"))


def unresolved(links: DataFrame) -> DataFrame:
    return links.where("match_status <> 'MATCHED' and reviewed_by is null")


def confirm(links: DataFrame, fights: DataFrame, questions: DataFrame, choices: DataFrame) -> DataFrame:
    """Links with the reviewers' choices (fight_url, token_id, reviewed_by)
    applied; a choice of an unknown bout or token raises."""
    bad = choices.join(fights, "fight_url", "left_anti").select("fight_url").union(choices.join(questions, "token_id", "left_anti").select("fight_url"))
    if not bad.limit(1).isEmpty():
        raise ValueError("a choice names an unknown bout or token")
    c = choices.select("fight_url", F.col("token_id").alias("_t"), F.col("reviewed_by").alias("_r"))
    done = F.col("_t").isNotNull()
    return links.join(c, "fight_url", "left").select(
        "fight_url", F.coalesce("_t", "token_id").alias("token_id"), F.when(done, "MATCHED").otherwise(F.col("match_status")).alias("match_status"),
        F.when(done, "HUMAN_CONFIRMED").otherwise(F.col("match_method")).alias("match_method"), "candidate_count", F.coalesce("_r", "reviewed_by").alias("reviewed_by"),
    )


def schedule(signals: DataFrame) -> DataFrame:
    """Captures due after each signal with a token: (signal_id, token_id,
    scheduled_offset, scheduled_at, status). The one at the start of the bout is
    SKIPPED where the start isn't known. Ids come from a hash, so that a rerun
    schedules the same captures."""
    items = [F.struct(F.lit(o).alias("scheduled_offset"), (F.col("created_at") + F.make_interval(hours=F.lit(h))).alias("scheduled_at"), F.lit("PENDING").alias("status")) for o, h in OFFSETS.items()]
    start = F.col("event_start_time")
    items.append(F.struct(F.lit(FIGHT_TIME).alias("scheduled_offset"), start.alias("scheduled_at"), F.when(start.isNull(), "SKIPPED").otherwise("PENDING").alias("status")))
    rows = signals.where("token_id is not null").select("signal_id", "token_id", F.explode(F.array(*items)).alias("s")).select("signal_id", "token_id", "s.*")
    return rows.withColumn("snapshot_id", F.sha2(F.concat_ws("|", "signal_id", "scheduled_offset"), 256))


def execute_due(scheduled: DataFrame, books: DataFrame, now: str) -> DataFrame:
    """Pending captures due at ``now``, filled from the first book at or after
    their time and not after ``now``; MISSED where there is none."""
    due = scheduled.where((F.col("status") == "PENDING") & (F.col("scheduled_at") <= F.lit(now).cast("timestamp_ntz")))
    quotes = [c for c in QUOTES if c in books.columns]
    seen = books.where(F.col("captured_at") <= F.lit(now).cast("timestamp_ntz")).select("token_id", F.col("captured_at").alias("scheduled_at"), *quotes)
    out = asof_join(due.drop("status", *quotes), seen, ["token_id"], "scheduled_at", quotes, forward=True)
    got = F.col("matched_at").isNotNull()
    return out.withColumn("status", F.when(got, "CAPTURED").otherwise("MISSED")).withColumn("failure_reason", F.when(~got, "no book at or after the time")).withColumnRenamed("matched_at", "actual_captured_at")


def resolved(verdicts: DataFrame) -> DataFrame:
    """Scoreboard entries: a veto is right where the favoured side lost, any
    other verdict where it won."""
    won = F.col("actual_winner_url") == F.col("signal_favored_url")
    return verdicts.withColumn("fight_resolved", F.lit(True)).withColumn("outcome_correct", F.when(F.col("verdict") == "VETO", ~won).otherwise(won))


def scoreboard(entries: DataFrame) -> DataFrame:
    """Counts, win rate and mean absolute mismatch by verdict, of resolved bouts."""
    count_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return entries.where("fight_resolved").groupBy("verdict").agg(
        F.count("*").alias("cnt"), count_if(F.col("outcome_correct")).alias("correct"), count_if(~F.col("outcome_correct")).alias("incorrect"),
        F.avg(F.abs("mismatch_at_signal")).alias("mean_mismatch"),
    ).withColumn("win_rate", F.col("correct") / F.col("cnt"))


VERDICT = "verdict string, confidence double, evidence_urls array<string>"
VERDICTS = ("CONFIRM", "QUALIFY", "VETO")


def parsed_verdicts(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Typed verdicts of JSON answers; ``error`` tells what is wrong with one."""
    v = F.from_json(column, VERDICT)
    error = (
        F.when(v.isNull() | v["verdict"].isNull(), "not a verdict").when(~v["verdict"].isin(*VERDICTS), "unknown verdict")
        .when(v["confidence"].isNull() | ~v["confidence"].between(0, 1), "confidence outside 0..1").when(F.coalesce(F.size(v["evidence_urls"]), F.lit(0)) < 1, "no evidence")
    )
    return answers.withColumn("parsed", v).withColumn("error", error)


def prompt(signal: str, sources: str) -> Column:
    """A question with its sources as a bullet list, or None."""
    items = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.concat(F.lit("Signal: "), F.col(signal), F.lit("\nSources:\n"), F.when(F.size(sources) > 0, items).otherwise("None"))
