"""Keyed writes, as-of and bucket joins, links, schedules and streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ringside.operators import asof, report, stores
from ringside.streaming import capture


def test_upserts(spark):
    cols = "k string, v int, at int"
    old, new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], cols), spark.createDataFrame([("b", 3, 2), ("b", 4, 3), ("c", 5, 1), (None, 6, 1)], cols)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(stores.upsert(old, new, ["k"], "at")) == [("a", 1, 1), ("b", 4, 3), ("c", 5, 1), (None, 6, 1)]
    assert rows(stores.partial_upsert(old, new, ["k"], "at", ["v"])) == [("a", 1, 1), ("b", 2, 3), ("c", 5, 1), (None, 6, 1)]
    assert rows(stores.insert_ignore(old, new, ["k"], "at")) == [("c", 5, 1), (None, 6, 1)]
    assert rows(stores.update_by_key(old, new.where("at = 3").select("k", "v"), ["k"])) == [("a", 1, 1), ("b", 4, 1)]
    with pytest.raises(stores.LinkOverwriteError):
        stores.guarded_upsert(old, new, ["k"], "at", F.col("v") == 2)
    assert stores.with_columns(old, x="double", v="int").columns == ["k", "v", "at", "x"]


def test_replace_swaps_whole_tables(spark, tmp_path):
    at = str(tmp_path / "t")
    stores.replace(spark.range(3), at)
    stores.replace(spark.read.parquet(at).where("id > 0"), at)  # reads what it replaces
    assert spark.read.parquet(at).count() == 2


def test_calls_are_made_once(spark):
    pending, done = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a",)], "k string")

    def call(row):
        if row["k"] == "c":
            raise RuntimeError("down")
        return {"verdict": row["k"] * 2}

    got = {r.k: (r.status, r.reason, r.verdict) for r in stores.pending_calls(pending, done, ["k"], call, "k string, status string, reason string, verdict string").collect()}
    assert got == {"b": ("success", None, "bb"), "c": ("failed", "RuntimeError: down", None)}


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1), ("a", 0)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 7, 70), ("b", 2, 20), ("a", 5, 40)], "k string, t int, v int")
    got = lambda **how: {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", ["v"], **how).collect()}
    assert got() == {("a", 5): 50, ("a", 10): 70, ("b", 1): None, ("a", 0): None}
    assert got(strict=True)["a", 5] is None
    assert got(forward=True) == {("a", 5): 50, ("a", 10): None, ("b", 1): 20, ("a", 0): 50}


def test_buckets(spark):
    dim = spark.createDataFrame([(0.1, 0.3, "x"), (0.3, 0.5, "y")], "lower double, upper double, id string")
    rows = spark.createDataFrame([(p,) for p in (0.0, 0.3, 0.31, 0.9)], "p double")
    assert [r.id for r in asof.bucket_join(rows, "p", dim).orderBy("p").collect()] == ["x", "x", "y", "y"]
    assert [r.id for r in asof.bucket_join(rows, "p", dim, to_lower=False).orderBy("p").collect()] == ["x", "y", "y", "y"]


def test_links(spark):
    fights = spark.createDataFrame([("f1", "a", "b"), ("f2", "a", "c"), ("f3", "a", "zz"), ("f4", "b", "c")], "fight_url string, fighter_a_url string, fighter_b_url string")
    fighters = spark.createDataFrame([("a", "José Aldo Jr."), ("b", "Max Holloway"), ("c", "Sean O'Malley")], "fighter_url string, name string")
    questions = spark.createDataFrame([("t1", "UFC: Will Jose Aldo beat Max Holloway?"), ("t2", "Sean OMalley v Jose Aldo"), ("t3", "sean omalley or jose aldo"), ("t4", None)], "token_id string, question string")
    got = {r.fight_url: (r.match_status, r.token_id, r.candidate_count) for r in report.resolve_links(fights, fighters, questions).collect()}
    assert got == {"f1": ("MATCHED", "t1", 1), "f2": ("MULTIPLE_CANDIDATES", "t2", 2), "f3": ("INVALID_INPUT", "", 0), "f4": ("NO_CANDIDATE", "", 0)}
    none = report.resolve_links(fights, fighters, questions.limit(0))
    assert {r.match_status for r in none.collect()} == {"MISSING_SNAPSHOT", "INVALID_INPUT"}
    links = report.resolve_links(fights, fighters, questions).withColumn("reviewed_by", F.lit(None).cast("string"))
    assert report.unresolved(links).count() == 3
    choice = spark.createDataFrame([("f2", "t3", "me")], "fight_url string, token_id string, reviewed_by string")
    done = {r.fight_url: r for r in report.confirm(links, fights, questions, choice).collect()}
    assert (done["f2"].match_status, done["f2"].match_method, done["f2"].token_id) == ("MATCHED", "HUMAN_CONFIRMED", "t3") and done["f1"].match_method == "AUTO_NAME"
    with pytest.raises(ValueError, match="unknown"):
        report.confirm(links, fights, questions, choice.withColumn("token_id", F.lit("nope")))


def test_schedule_and_capture(spark):
    at = datetime(2026, 3, 15, 14)
    signals = spark.createDataFrame([("s1", "t", at, None), ("s2", None, at, at), ("s3", "u", at, at + timedelta(hours=30))], "signal_id string, token_id string, created_at timestamp_ntz, event_start_time timestamp_ntz")
    due = report.schedule(signals)
    got = {(r.signal_id, r.scheduled_offset): (r.scheduled_at, r.status) for r in due.collect()}
    assert len(got) == 8 and got["s1", "FIGHT_TIME"] == (None, "SKIPPED") and got["s3", "24H"] == (at + timedelta(hours=24), "PENDING")
    books = spark.createDataFrame([("t", at + timedelta(hours=2), 0.6), ("t", at + timedelta(hours=3), 0.7)], "token_id string, captured_at timestamp_ntz, mid_price double")
    done = {(r.signal_id, r.scheduled_offset): (r.status, r.mid_price) for r in report.execute_due(due, books, "2026-03-15 20:00:00").collect()}
    assert done == {("s1", "1H"): ("CAPTURED", 0.6), ("s1", "4H"): ("MISSED", None), ("s3", "1H"): ("MISSED", None), ("s3", "4H"): ("MISSED", None)}


def test_scoreboard_and_prompts(spark):
    v = spark.createDataFrame([("VETO", 0.1, "b", "a"), ("CONFIRM", -0.3, "a", "a"), ("CONFIRM", 0.1, None, "a")], "verdict string, mismatch_at_signal double, actual_winner_url string, signal_favored_url string")
    got = {r.verdict: r for r in report.scoreboard(report.resolved(v)).collect()}
    assert (got["VETO"].correct, got["CONFIRM"].cnt, got["CONFIRM"].correct, got["CONFIRM"].incorrect) == (1, 2, 1, 0) and got["CONFIRM"].mean_mismatch == pytest.approx(0.2)
    df = spark.createDataFrame([("s", ["x", "y"]), ("s", [])], "sig string, src array<string>")
    assert [r[0] for r in df.select(report.prompt("sig", "src")).collect()] == ["Signal: s\nSources:\n- x\n- y", "Signal: s\nSources:\nNone"]


def test_capture_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    one = spark.createDataFrame([(1, datetime(2024, 1, 1), 7, "v", 10.0, "{}"), (2, datetime(2024, 1, 1), 7, "v", 10.0, "{}"), (3, None, 7, "v", 1.0, "{}")], capture.EVENTS)
    one.coalesce(1).write.parquet(str(src / "a"))
    stream = lambda: capture.quotes(spark.readStream.schema(capture.EVENTS).option("recursiveFileLookup", "true").parquet(str(src)))
    capture.capture(stream(), out, str(tmp_path / "c")).awaitTermination()
    one.coalesce(1).write.parquet(str(src / "b"))  # the same rows come again
    capture.capture(stream(), out, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(f"{out}/good").count() == 1 and spark.read.parquet(f"{out}/bad").count() == 2
