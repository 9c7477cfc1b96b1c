"""Tables, paged services, crawls, configuration and the quality run."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from ringside import schemas, validate
from ringside.operators import stores
from ringside.sources import remote

from .test_parsing import FIGHT


def test_open_tables(spark, tmp_path):
    spark.createDataFrame([("f", "a")], "fight_url string, fighter_url string").write.parquet(str(tmp_path / "fight_totals"))
    t = schemas.opened(spark, str(tmp_path))
    assert set(t) == set(schemas.TABLES) and len(t) == 15 and len(t["paper_signals"].columns) == 34 and t["fights"].count() == 0
    row = t["fight_totals"].first()
    assert row.knockdowns == 0 and row.control_time_seconds is None and t["fight_totals"].schema.simpleString() == schemas.TABLES["fight_totals"].schema.simpleString()
    good, bad = schemas.checked(spark.createDataFrame([("u", 1), (None, 2)], "event_url string, x int"), "events")
    assert (good.count(), bad.count()) == (1, 1)


def test_retry_and_pages():
    calls, waits = [], []

    def fetch(limit, offset):
        calls.append(offset)
        if len(calls) < 3:
            raise OSError("down")
        return list(range(offset, min(offset + limit, 250)))

    assert list(remote.paged(remote.retrying(fetch, sleep=waits.append))) == list(range(250))
    assert waits == [1.0, 2.0] and calls == [0, 0, 0, 100, 200]
    with pytest.raises(OSError, match="down"):
        remote.retrying(lambda: (_ for _ in ()).throw(OSError("down")), sleep=waits.append)()


def _site(url: str) -> str:
    if url == "/list":
        return '<a class="b-link b-link_style_black" href="/event-details/1">x</a><a class="b-link b-link_style_black" href="/event-details/broken">x</a>'
    if url == "/event-details/1":
        return '<span class="b-content__title-highlight">E</span><table><tr class="b-fight-details__table-row" data-link="/fight-details/9"></tr></table>'
    if url == "/fight-details/9":
        return FIGHT
    if "fighter-details" in url:
        return '<span class="b-content__title-highlight">P</span>'
    raise OSError("gone")


def test_crawl(spark):
    rows = remote.crawl(spark, "/list", _site)
    assert [r.name for r in rows["event"].collect()] == ["E"] and rows["fighter"].count() == 2
    tables = remote.routed(rows["fight"])
    assert {k: v.count() for k, v in tables.items()} == {"fights": 1, "fight_totals": 2, "round_stats": 4, "sig_strike_breakdowns": 2}
    assert schemas.conformed(tables["round_stats"], "round_stats").first().fight_url == "/fight-details/9"


def test_config(tmp_path):
    assert remote.config(None, {"a": 1}) == {"a": 1} == remote.config(str(tmp_path / "no.yaml"), {"a": 1})
    (tmp_path / "c.yaml").write_text("a: 2\nb: x\n")
    assert remote.config(str(tmp_path / "c.yaml"), {"a": 1, "c": 3}) == {"a": 2, "b": "x", "c": 3}


def test_quality_run(spark, tmp_path):
    root, out = str(tmp_path / "t"), str(tmp_path / "out")
    write = lambda name, rows, cols: stores.replace(schemas.conformed(spark.createDataFrame(rows, cols), name), f"{root}/{name}")
    write("events", [("e", "2024-01-01")], "event_url string, date string")
    write("fights", [("f", "e", "a", "b", "a", 1, "3 Rnd (5-5-5)")], "fight_url string, event_url string, fighter_a_url string, fighter_b_url string, winner_url string, ending_round int, time_format string")
    assert validate.run(spark, root, out, today="2024-02-01")
    write("fights", [("f", "e", "a", "a", "z", 1, "3 Rnd (5-5-5)")], "fight_url string, event_url string, fighter_a_url string, fighter_b_url string, winner_url string, ending_round int, time_format string")
    assert not validate.run(spark, root, out, today="2024-02-01")
    assert spark.read.parquet(f"{out}/validation_quarantine").count() == 2  # the earlier run's is replaced
    (part,) = Path(out, "validation_report").glob("part-*.json")
    report = json.loads(part.read_text())
    assert report["counts_by_reason"] == {"SELF_FIGHT": 1, "WINNER_NOT_IN_FIGHT": 1} and report["label_universe_violations"] == 2
