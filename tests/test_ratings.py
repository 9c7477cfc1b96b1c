"""Ratings and prestige: worked values and properties."""

from __future__ import annotations

import math
import random

import pytest

from ringside.operators import pagerank, ratings

COLS = "fight_url string, tick int, day int, a string, b string, winner string, method string, ending_round int"


def bouts(spark, rows):
    return spark.createDataFrame([(f"f{i}", *r) for i, r in enumerate(rows)], COLS)


def after(spark, rows, system, who, day=None):
    """Values after all rows: what a last bout at a later tick sees."""
    last = (max(r[0] for r in rows) + 1, day or rows[-1][1] + 1, who, "z", None, "Draw", 3)
    got = ratings.rated(bouts(spark, [*rows, last]), (system,)).where(f"fight_url = 'f{len(rows)}' and fighter = '{who}'").first()
    return got


@pytest.mark.parametrize(("method", "gain"), [("Decision - Unanimous", 16), ("KO/TKO", 22.4), ("Submission", 20.8), ("DQ", 1.6), ("Could Not Continue", 0), ("TKO - Doctor's Stoppage", 0)])
def test_elo_of_two_debutants(spark, method, gain):
    rows = [(1, 100, "a", "b", "a", method, 3)]
    assert after(spark, rows, "elo", "a")["v0"] == pytest.approx(1500 + gain)
    assert after(spark, rows, "elo", "b")["v0"] == pytest.approx(1500 - gain)


def test_elo_decays_only_after_the_period():
    e = ratings.Elo()
    e.of = {w: [1600.0, 1600.0, [1600.0], 0, 1] for w in "ab"}
    e.apply(360, "a", "b", None, "Could Not Continue")
    assert e.of["a"][0] == pytest.approx(1581)
    e.of = {w: [1600.0, 1600.0, [1600.0], 0, 1] for w in "ab"}
    e.apply(180, "a", "b", None, "Could Not Continue")
    assert e.of["a"][0] == 1600 and e.of["a"][4] == 2


def test_bouts_of_one_tick_do_not_see_each_other(spark):
    rows = [(1, 100, "a", "b", "a", "KO/TKO", 1), (1, 100, "a", "c", "a", "KO/TKO", 1), (2, 107, "a", "d", None, "Draw", 3)]
    got = {r["fight_url"]: r["v0"] for r in ratings.rated(bouts(spark, rows), ("elo",)).where("fighter = 'a'").collect()}
    assert got["f0"] is None and got["f1"] is None and got["f2"] > 1540


def test_slope_needs_five(spark):
    rows = [(i, 10 * i, "a", f"b{i}", "a", "Decision", 3) for i in range(1, 6)]
    assert after(spark, rows[:4], "elo", "a")["v2"] is None
    assert after(spark, rows, "elo", "a")["v2"] > 0


def test_glicko_skips_and_moves(spark):
    same = after(spark, [(1, 100, "a", "b", "a", "Overturned", 3)], "glicko2", "a")
    assert (same["v0"], same["v1"]) == (1500, 350)
    won, lost = (after(spark, [(1, 100, "a", "b", "a", "Submission", 3)], "glicko2", w) for w in "ab")
    assert won["v0"] > 1500 > lost["v0"] and won["v1"] < 350 and lost["v1"] < 350
    assert won["v0"] - 1500 != pytest.approx(1500 - lost["v0"], abs=1e-3)  # the second is updated against the first's new values


def test_leagues_are_folded_apart(spark):
    rows = bouts(spark, [(1, 100, "a", "b", "a", "KO/TKO", 1), (2, 107, "a", "b", "a", "KO/TKO", 1)]).withColumn("league", __import__("pyspark.sql.functions", fromlist=["col"]).col("fight_url"))
    assert all(r["v0"] is None for r in ratings.rated(rows, ("elo",), league="league").collect())


def prestige(spark, rows, *ticks):
    """Scores by node (by tick and node for several ticks), equal to a plain power iteration's."""
    given = bouts(spark, rows)
    nodes, edges = pagerank.graphs(given, spark.createDataFrame([(t,) for t in ticks], "as_of int"))
    got = {(r["as_of"], r["node"]): r["score"] for r in pagerank.ranked(nodes, edges).collect()}
    assert got == pytest.approx({(t, k): v for t in ticks for k, v in plain([r for r in rows if r[0] < t]).items()}, abs=1e-12)
    return got if len(ticks) > 1 else {k: v for (_, k), v in got.items()}


def plain(rows):
    nodes, weight = {w for r in rows for w in r[2:4]}, {}
    ref = max((r[1] for r in rows if r[4]), default=0)
    for _, day, a, b, winner, method, last in rows:
        if winner:
            key = (b if winner == a else a, winner)
            worth = 1 + {"KO/TKO": 0.3, "Submission": 0.2}.get(method, 0) + (0.1 if last <= 2 else 0)
            weight[key] = weight.get(key, 0) + worth * math.exp(-0.3 * (ref - day) / 365.25)
    n, out = len(nodes), {u: sum(w for (s, _), w in weight.items() if s == u) for u in nodes}
    x = {u: 1 / n for u in nodes}
    for _ in range(100):
        lost = sum(x[u] for u in nodes if not out[u])
        new = {u: 0.85 * (sum(x[s] * w / out[s] for (s, t), w in weight.items() if t == u) + lost / n) + 0.15 / n for u in nodes}
        moved, x = sum(abs(new[u] - x[u]) for u in nodes), new
        if moved < n * 1e-6:
            break
    met = {u for pair in weight for u in pair}
    return {u: x[u] if u in met else min(x.values()) for u in nodes}


def test_pagerank_stops_each_graph_by_itself(spark):
    rng = random.Random(4)
    rows = [(t, 30 * t, *(pair := rng.sample("abcdefgh", 2)), rng.choice([*pair, None]), rng.choice(["KO/TKO", "Decision"]), rng.randint(1, 3)) for t in range(60)]
    assert len(prestige(spark, rows, 2, 10, 30, 60)) > 20


def test_pagerank_of_one_bout_and_of_isolated_nodes(spark):
    one = prestige(spark, [(1, 100, "a", "b", "a", "KO/TKO", 1)], 2)
    assert one["a"] == pytest.approx(0.649123, abs=1e-5) and one["b"] == pytest.approx(0.350877, abs=1e-5)
    more = prestige(spark, [(1, 100, "a", "b", "a", "KO/TKO", 1), (1, 100, "c", "d", None, "Draw", 3)], 2)
    assert more["c"] == more["d"] == min(more.values())
    assert prestige(spark, [(5, 100, "a", "b", "a", "KO/TKO", 1)], 5) == {}


def test_pagerank_prefers_recent_and_finishes(spark):
    rows = [(1, 100, "a", "x", "a", "Decision", 3), (2, 2000, "b", "x", "b", "Decision", 3)]
    p = prestige(spark, rows, 3)
    assert p["b"] > p["a"]
    rows = [(1, 100, "a", "x", "a", "Decision", 3), (1, 100, "b", "x", "b", "KO/TKO", 1)]
    p = prestige(spark, rows, 3)
    assert p["b"] > p["a"]
