"""Both sides of a bout come together; what isn't asked for isn't made."""

from __future__ import annotations

import random

import pytest

from ringside.operators import dealt, model, ratings
from ringside.plans import features as feats



def tables(spark, n=500):
    rng = random.Random(4)
    sides = [(f"b{i}", s, None if rng.random() < 0.2 else rng.random(), f"w{rng.randrange(9)}") for i in range(n) for s in (0, 1)]
    bouts = [(f"b{i}", i) for i in range(n)]
    rng.shuffle(sides)
    return sides, bouts, spark.createDataFrame(sides, "fight_url string, side int, v double, t string").repartition(5), spark.createDataFrame(bouts, "fight_url string, k int").repartition(3)


@pytest.mark.parametrize("both", [True, False])
def test_sides_are_laid_beside_each_other(spark, monkeypatch, both):
    monkeypatch.setattr(dealt, "ROWS", 64)
    sides, bouts, a, b = tables(spark)
    of, k = {(u, s): (v, t) for u, s, v, t in sides}, dict(bouts)
    got = dealt.side_by_side([a.select("fight_url", "side", "v"), b, a.select("fight_url", "side", "t")], 500, both).collect()
    assert len(got) == (1000 if both else 500)
    for r in got:
        assert (r.x_v, r.x_t) == of[r.fight_url, r.side] and (r.y_v, r.y_t) == of[r.fight_url, 1 - r.side] and r.k == k[r.fight_url]


def test_a_missing_side_is_told(spark):
    _, _, a, b = tables(spark, 40)
    with pytest.raises(Exception, match="UnpairedError"):
        dealt.side_by_side([a.where("fight_url <> 'b7' or side = 0"), b], 40, True).collect()
    with pytest.raises(Exception, match="UnpairedError"):
        dealt.side_by_side([a, b.where("fight_url <> 'b7'")], 40, True).collect()


def test_fields_are_those_the_formulas_read():
    made = feats.formulas(("win_pct_all", "days_since_last_fight", "reach_delta", "damage_ratio"))
    assert feats.read_by(made.values()) == ("event_date", "fights", "last_state.day", "reach_cm", "rolling.avg_damage_ratio", "wins")


def test_the_matrix_reads_no_more_than_its_columns():
    made = feats.formulas((*model.SIDED_RATED, *model.SHARED_RATED))
    fields = feats.read_by(made.values())
    assert len(fields) < 20 and sum(f.startswith("rolling.") for f in fields) == 4


def test_many_bouts_are_rated_as_one_by_one(spark):
    rng = random.Random(5)
    rows = []
    for tick in range(1, 12):
        for i in range(rng.choice((3, 150))):
            a, b = rng.sample(range(90), 2)
            rows.append((f"f{tick:03}{i:04}", tick, tick * 40, f"c{a}", f"c{b if i else a}", rng.choice((f"c{a}", f"c{b}", None)), rng.choice(("KO/TKO", "Submission", "Draw", "DQ", "TKO - Doctor's Stoppage"))))
    df = spark.createDataFrame(rows, "fight_url string, tick int, day int, a string, b string, winner string, method string")
    for system, kind in (("elo", ratings.Elo), ("glicko2", ratings.Glicko2)):
        got = {(r.fight_url, r.side): (r.v0, r.v1, r.v2, r.v3) for r in ratings.rated(df, (system,)).collect()}
        one = kind()
        for tick in range(1, 12):
            mine = [r for r in rows if r[1] == tick]
            for r in mine:
                assert got[r[0], 0] == pytest.approx(one.seen(r[3])) and got[r[0], 1] == pytest.approx(one.seen(r[4]))
            for r in mine:
                one.apply(*r[2:])
