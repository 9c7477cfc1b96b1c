"""Pages made from bouts, read back by the parsers; prompts and confirmed links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..plans.bouts import FROM_SALES
from ..plans.dialect import Duck
from ..sources.html import pages_to_rows
from . import market
from .base import Registry, tables

_r = Registry()
SALES = ("lineitem", "orders", "customer")
_BOUTS_SQL = FROM_SALES.then(("out", lambda d: "SELECT 1")).text(Duck()).rsplit("SELECT 1", 1)[0].rstrip()


def _bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FROM_SALES.then(("out", lambda d: "SELECT * FROM bouts")).run(spark, tables(spark, sf_dir, *SALES))


def _glued(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _row(cells: list) -> Column:
    """A table row whose cells hold a paragraph for each side."""
    return _glued("<tr>", *[x for a, b in cells for x in ("<td><p>", a, "</p><p>", b, "</p></td>")], "</tr>")


def _fight_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = lambda make: (make("a"), make("b"))
    n = lambda c: both(lambda s: F.col(f"{s}_{c}"))
    of = lambda x, y: both(lambda s: _glued(F.col(f"{s}_{x}"), "  of ", F.col(f"{s}_{y}")))
    clock = both(lambda s: _glued(F.floor(F.col(f"{s}_ctrl") / 60), ":", F.lpad((F.col(f"{s}_ctrl") % 60).cast("string"), 2, "0")))
    none = ("---", "---")
    totals = _row([("A", "B"), n("kd"), of("sig_l", "sig_a"), none, of("tot_l", "tot_a"), of("td_l", "td_a"), none, n("sub"), n("rev"), clock])
    splits = _row([("A", "B"), of("sig_l", "sig_a"), none, of("td_l", "sig_a"), none, none, none, none, of("sig_l", "tot_a")])
    head = lambda marker: f"<thead><tr><th>Fighter</th><th>{marker}</th></tr></thead>"
    rounds = F.array_join(F.transform(F.sequence(F.lit(1), "ending_round"), lambda i: totals), "")
    stats = _glued(
        "<table>", head("KD"), "<tbody>", totals, "</tbody></table><table>", head("KD"), "<thead><tr><th>Round</th></tr></thead><tbody>", rounds,
        "</tbody></table><table>", head("Head"), "<tbody>", splits, "</tbody></table>",
    )
    person = lambda s: _glued(
        '<div class="b-fight-details__person"><i class="b-fight-details__person-status"> ', F.when(F.col("winner") == F.col(s), "W").otherwise("L"),
        ' </i><a class="b-link" href="/fighter-details/', F.col(s), '">x</a></div>',
    )
    item = lambda label, v: _glued(f'<i class="b-fight-details__text-item"><i>{label}:</i> ', v, "</i>")
    page = _glued(
        person("a"), person("b"), '<i class="b-fight-details__fight-title"> ', F.col("weight_class"), "\n</i>", item("Method", F.col("method")), item("Round", F.col("ending_round")),
        item("Time", F.col("ending_time")), item("Time format", F.col("time_format")), item("Referee", F.lit("")), F.when(F.col("has"), stats).otherwise(""),
    )
    return _bouts(spark, sf_dir).select(F.col("fight_url").alias("url"), page.alias("html"))


def page_fights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages_to_rows(_fight_page(spark, sf_dir), "fight")
    whole = F.filter("breakdowns", lambda x: x["round"] == 0)
    rows = rows.select("*", F.size("rounds").cast("long").alias("n_rounds"), F.explode_outer(F.arrays_zip(F.col("totals").alias("t"), whole.alias("s"))).alias("x"))
    return rows.select(
        F.col("page_url").alias("fight_url"), "fighter_a_url", "fighter_b_url", "winner_url", "method", F.col("ending_round").cast("long").alias("ending_round"), "ending_time", "time_format", "referee", "weight_class", "n_rounds",
        F.col("x.t.fighter_url").alias("fighter_url"), *[F.col(f"x.t.{c}").cast("double").alias(c) for c in _TOTALS], F.col("x.s.head_landed").cast("double").alias("head_landed"), F.col("x.s.ground_attempted").cast("double").alias("ground_attempted"),
    )


_TOTALS = {
    "knockdowns": "kd", "significant_strikes_landed": "sig_l", "significant_strikes_attempted": "sig_a", "total_strikes_landed": "tot_l", "total_strikes_attempted": "tot_a",
    "takedowns_landed": "td_l", "takedowns_attempted": "td_a", "submission_attempts": "sub", "reversals": "rev", "control_time_seconds": "ctrl",
}
_own = lambda c, name: f"CASE WHEN has THEN CASE WHEN side = 0 THEN a_{c} ELSE b_{c} END END::DOUBLE AS {name}"
_r.add("page_fights", page_fights, f"""{_BOUTS_SQL}
SELECT fight_url, '/fighter-details/' || a AS fighter_a_url, '/fighter-details/' || b AS fighter_b_url, '/fighter-details/' || winner AS winner_url, method, ending_round::BIGINT AS ending_round, ending_time, time_format,
  CAST(NULL AS VARCHAR) AS referee, weight_class, CASE WHEN has THEN 2 * ending_round ELSE 0 END::BIGINT AS n_rounds, CASE WHEN has THEN '/fighter-details/' || CASE WHEN side = 0 THEN a ELSE b END END AS fighter_url,
  {", ".join(_own(c, n) for n, c in _TOTALS.items())}, {_own("td_l", "head_landed")}, {_own("tot_a", "ground_attempted")}
FROM bouts, (VALUES (0), (1)) sides(side) WHERE has OR side = 0""")


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event pages with a row for each bout, some without a place."""
    row = _glued('<tr class="b-fight-details__table-row" data-link="/fight-details/', F.col("fight_url"), '"><td>x</td></tr>')
    events = _bouts(spark, sf_dir).groupBy("event_url", "event_date").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    place = F.when(F.dayofmonth("event_date") % 5 == 0, "").otherwise(_glued('<li class="b-list__box-list-item"><i>Location:</i> Place ', F.month("event_date"), "</li>"))
    page = _glued(
        '<span class="b-content__title-highlight"> Night of ', F.col("event_url"), ' </span><li class="b-list__box-list-item">Date: ', F.date_format("event_date", "MMMM d, yyyy"), "</li>", place, F.col("rows"),
    )
    rows = pages_to_rows(events.select(F.col("event_url").alias("url"), page.alias("html")), "event")
    return rows.select(F.col("page_url").alias("event_url"), "name", F.col("date").cast("string").alias("day"), "location", F.array_join("fight_urls", ",").alias("fights"))


_r.add("page_events", page_events, f"""{_BOUTS_SQL}
SELECT event_url, 'Night of ' || event_url AS name, CAST(event_date AS VARCHAR) AS day, CASE WHEN day(event_date) % 5 <> 0 THEN 'Place ' || month(event_date) END AS location,
  string_agg('/fight-details/' || fight_url, ',' ORDER BY fight_url) AS fights FROM bouts GROUP BY event_url, event_date""")


def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of each year's events, with links twice and links to other pages."""
    link = lambda kind: _glued(f'<a class="b-link b-link_style_black" href="/{kind}-details/', F.col("event_url"), '">x</a>')
    events = _bouts(spark, sf_dir).select("event_url", F.year("event_date").cast("string").alias("url")).distinct()
    pages = events.groupBy("url").agg(F.array_join(F.collect_list(_glued(link("event"), link("fighter"), link("event"))), "").alias("html"))
    return pages_to_rows(pages, "events_list").select(F.col("page_url").alias("year"), "event_url")


_r.add("page_listing", page_listing, f"{_BOUTS_SQL}\nSELECT DISTINCT CAST(year(event_date) AS VARCHAR) AS year, '/event-details/' || event_url AS event_url FROM bouts")


def page_fighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir, "supplier")["supplier"]
    k = F.col("s_suppkey")
    item = lambda label, v: _glued(f'<li class="b-list__box-list-item"><i>{label}:</i> ', v, "</li>")
    page = _glued(
        '<span class="b-content__title-highlight">\n ', F.col("s_name"), "</span>", item("Height", F.when(k % 17 == 0, "--").otherwise(_glued(5 + k % 2, "' ", k % 12, '"'))), item("Weight", _glued(115 + k % 150, " lbs.")),
        item("Reach", F.when(k % 13 == 0, "--").otherwise(_glued(60 + k % 25, '"'))), item("STANCE", F.when(k % 3 == 0, "").when(k % 3 == 1, "Orthodox").otherwise("Southpaw")),
        item("DOB", F.when(k % 19 == 0, "--").otherwise(F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), (k % 7000).cast("int")), "MMM dd, yyyy"))),
    )
    rows = pages_to_rows(s.select(k.cast("string").alias("url"), page.alias("html")), "fighter")
    return rows.select("page_url", "name", "height_cm", "weight_kg", "reach_cm", "stance", F.col("date_of_birth").cast("string").alias("born"))


_r.add("page_fighters", page_fighters, """SELECT CAST(s_suppkey AS VARCHAR) AS page_url, s_name AS name, CASE WHEN s_suppkey % 17 <> 0 THEN round_even(((5 + s_suppkey % 2) * 12 + s_suppkey % 12) * 2.54::DOUBLE, 1) END AS height_cm,
  round_even((115 + s_suppkey % 150) * 0.45359237::DOUBLE, 1) AS weight_kg, CASE WHEN s_suppkey % 13 <> 0 THEN round_even((60 + s_suppkey % 25) * 2.54::DOUBLE, 1) END AS reach_cm,
  CASE s_suppkey % 3 WHEN 1 THEN 'Orthodox' WHEN 2 THEN 'Southpaw' END AS stance, CASE WHEN s_suppkey % 19 <> 0 THEN CAST(DATE '1960-01-01' + CAST(s_suppkey % 7000 AS INT) AS VARCHAR) END AS born FROM supplier""")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for signals with none, one or two sources."""
    d = tables(spark, sf_dir, "labels")["labels"]
    sources = F.slice(F.array(F.concat(F.lit("news "), F.col("doc_id").cast("string")), F.lit("odds")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    rows = d.select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("signal"), sources.alias("sources"))
    return rows.select("doc_id", report.prompt("signal", "sources").alias("prompt"))


_r.add("prompts", prompts, r"""SELECT doc_id, 'Signal: s' || doc_id || chr(10) || 'Sources:' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'None' WHEN 1 THEN '- news ' || doc_id ELSE '- news ' || doc_id || chr(10) || '- odds' END AS prompt FROM labels""")


def links_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer takes the shown token of every bout with several candidates."""
    fights, fighters, questions = market._market_side(spark, sf_dir)
    links = report.resolve_links(fights, fighters, questions).withColumn("reviewed_by", F.lit(None).cast("string"))
    choices = links.where("match_status = 'MULTIPLE_CANDIDATES'").select("fight_url", "token_id", F.lit("ann").alias("reviewed_by"))
    return report.confirm(links, fights, questions, choices)


_r.add("links_confirmed", links_confirmed, f"""SELECT fight_url, token_id, CASE WHEN several THEN 'MATCHED' ELSE match_status END AS match_status, CASE WHEN several THEN 'HUMAN_CONFIRMED' ELSE match_method END AS match_method,
  candidate_count, CASE WHEN several THEN 'ann' END AS reviewed_by FROM (SELECT *, match_status = 'MULTIPLE_CANDIDATES' AS several FROM ({market.SQL["links"]}) l) x""")

QUERIES, SQL = _r.queries, _r.sql
