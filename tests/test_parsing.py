"""Cells, names, pages and payloads."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ringside.functions import cells
from ringside.functions.names import canonical
from ringside.sources import html, markets


def test_cells(spark):
    row = spark.createDataFrame([("  a \n b ", "12 of 30", "---", " 4:05", "--", "6' 4\"", "80\"", "185 lbs.", "July 4, 2020", "Jul 32, 2020")], "a string, b string, c string, d string, e string, f string, g string, h string, i string, j string")
    got = row.select(
        cells.clean("a").alias("a"), cells.landed_attempted(F.col("b")).alias("b"), cells.landed_attempted(F.col("c")).alias("c"), cells.control_seconds(F.col("d")).alias("d"), cells.control_seconds(F.col("e")).alias("e"),
        cells.height_cm(F.col("f")).alias("f"), cells.reach_cm(F.col("g")).alias("g"), cells.weight_kg(F.col("h")).alias("h"), cells.long_date(F.col("i")).alias("i"), cells.short_date(F.col("j")).alias("j"), cells.to_int(F.lit("--")).alias("k"),
    ).first()
    assert (got.a, tuple(got.b), tuple(got.c), got.d, got.e) == ("a b", (12, 30), (0, 0), 245, None)
    assert (got.f, got.g, got.h, got.i, got.j, got.k) == (193.0, 203.2, 83.9, date(2020, 7, 4), None, 0)


def test_label_values(spark):
    got = spark.range(1).select(cells.label_values(F.array(F.lit("Height: 6' 1\""), F.lit("Reach: --"), F.lit("none"), F.lit("DOB: Jan 1, 1990"), F.lit("DOB: x: y"))).alias("m")).first().m
    assert got == {"Height": "6' 1\"", "DOB": "x: y"}


@pytest.mark.parametrize(("raw", "want"), [
    ("José Aldo", "jose aldo"), ("Robert Whittaker Jr.", "robert whittaker"), ("O'Malley", "omalley"), ("Jan Błachowicz", "jan błachowicz"), ("Khalil  Rountree Jr", "khalil rountree"),
    ("Antônio Rodrigo Nogueira", "antonio rodrigo nogueira"), ("Jean-Paul", "jeanpaul"), ("John III", "john"), ("  ", ""), ("A_B", "ab"), (None, None), ("Ivan", "ivan"), ("Smith v", "smith"), ("Sr. Jones", "sr jones"),
])
def test_names(raw, want):
    assert canonical(raw) == want


CELL = "<td><p>{}</p><p>{}</p></td>"
HEADS = "<thead><tr><th>Fighter</th><th>{}</th></tr></thead>"


def row(*pairs):
    return "<tr>" + "".join(CELL.format(a, b) for a, b in pairs) + "</tr>"


TOTALS = (("A", "B"), ("1", "0"), ("10 of 20", "5 of 9"), ("50%", "55%"), ("12 of 25", "6 of 10"), ("2 of 3", "0 of 1"), ("66%", "---"), ("1", "0"), ("0", "1"), ("2:05", "--"))
SPLIT = (("A", "B"), ("10 of 20", "5 of 9"), ("50%", "55%"), ("6 of 10", "1 of 2"), ("2 of 5", "2 of 3"), ("2 of 5", "2 of 4"), ("8 of 16", "5 of 9"), ("1 of 2", "0 of 0"), ("1 of 2", "0 of 0"))
FIGHT = f"""<div class="b-fight-details__person"><i class="b-fight-details__person-status"> L </i><a class="b-link" href="http://x/fighter-details/a">A</a></div>
<div class="b-fight-details__person"><i class="b-fight-details__person-status"> W </i><a class="b-link" href="http://x/fighter-details/b">B</a></div>
<i class="b-fight-details__fight-title"> Lightweight
 Bout </i><i class="b-fight-details__text-item_first"><i>Method:</i> <i>KO/TKO</i></i><i class="b-fight-details__text-item">Round: 2</i><i class="b-fight-details__text-item">Time: 3:30</i>
<i class="b-fight-details__text-item">Time format: 3 Rnd (5-5-5)</i><i class="b-fight-details__text-item">Referee: <span>Herb</span></i>
<table>{HEADS.format('KD')}<tbody>{row(*TOTALS)}</tbody></table><table>{HEADS.format('KD')}<thead><tr><th>Round 1</th></tr></thead><tbody>{row(*TOTALS)}{row(*TOTALS)}</tbody></table>
<table>{HEADS.format('Head')}<tbody>{row(*SPLIT)}</tbody></table>"""


def test_fight_page(spark):
    (got,) = html.parse_fight(FIGHT)
    assert got["winner_url"].endswith("/b") and (got["method"], got["ending_round"], got["ending_time"], got["time_format"], got["referee"], got["weight_class"]) == ("KO/TKO", 2, "3:30", "3 Rnd (5-5-5)", "Herb", "Lightweight Bout")
    a, b = got["totals"]
    assert (a["significant_strikes_landed"], a["takedowns_attempted"], a["control_time_seconds"], b["control_time_seconds"], b["reversals"]) == (10, 3, 125, None, 1)
    assert [(r["round"], r["fighter_url"][-1]) for r in got["rounds"]] == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert [(r["round"], r["head_landed"]) for r in got["breakdowns"]] == [(0, 6), (0, 1)]
    pages = spark.createDataFrame([("u1", FIGHT), ("u1", FIGHT)], "url string, html string")
    rows = html.pages_to_rows(pages, "fight").collect()
    assert len(rows) == 1 and rows[0].rounds[3].knockdowns == 0


def test_other_pages():
    links = '<a class="b-link b-link_style_black" href="/event-details/1">x</a><a class="b-link b-link_style_black" href="/event-details/1">x</a><a class="b-link" href="/event-details/2">y</a>'
    assert html.parse_events_list(links) == [{"event_url": "/event-details/1"}]
    page = '<span class="b-content__title-highlight"> UFC  1 </span><li class="b-list__box-list-item"><i>Date:</i> November 12, 1993</li><li class="b-list__box-list-item">Location: Denver</li><tr class="b-fight-details__table-row" data-link="/fight-details/9"></tr>'
    assert html.parse_event(page) == [{"name": "UFC 1", "date": date(1993, 11, 12), "location": "Denver", "fight_urls": ["/fight-details/9"]}]
    bio = '<span class="b-content__title-highlight">P</span><li class="b-list__box-list-item">Height: 6\' 4"</li><li class="b-list__box-list-item">Weight: 185 lbs.</li><li class="b-list__box-list-item">Reach: --</li><li class="b-list__box-list-item">STANCE: Orthodox</li><li class="b-list__box-list-item">DOB: Jul 22, 1989</li>'
    assert html.parse_fighter(bio) == [{"name": "P", "height_cm": 193.0, "weight_kg": 83.9, "reach_cm": None, "stance": "Orthodox", "date_of_birth": date(1989, 7, 22)}]
    assert html.parse_event(None)[0]["name"] == "" and html.parse_events_list("") == []


def test_books(spark):
    schema = "id int, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
    rows = [(1, [(0.5, 80.0), (0.55, 150.0)], [(0.65, 50.0), (0.6, 120.0)]), (2, [], [(0.6, 1.0)]), (3, [(1.0, 5.0)], [])]
    good, bad = markets.snapshots(spark.createDataFrame(rows, schema))
    got = {r.id: r for r in good.collect()}
    assert (got[1].best_bid, got[1].best_ask_size, round(got[1].mid_price, 6), round(got[1].spread, 6)) == (0.55, 120.0, 0.575, 0.05)
    assert got[2].mid_price is None and got[2].best_ask == 0.6 and [r.id for r in bad.collect()] == [3]
