"""Training matrix, ablation rungs, boosted trees and symmetric inference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Part, columns

#: Columns that must never be features, and those that describe the bout. Fixed values.
MARKET = (
    "opening_implied_prob", "closing_implied_prob", "line_movement_magnitude", "line_movement_direction", "spread_at_close", "depth_at_close", "volume_last_24hr",
)
META = ("fight_url", "event_url", "event_date", "fighter_url_a", "fighter_url_b", "weight_class", "outcome")
#: Name parts of each rung; a rung takes those before it as well. Fixed values.
RUNGS = {
    "naive": (),
    "record": ("win_pct", "current_streak", "finish_rate"),
    "physical": ("height_cm", "reach_cm", "reach_to_height", "age_at_fight", "days_since_last_fight", "fights_last_12mo", "total_ufc_fights", "inactivity_tier"),
    "schedule_strength": ("elo_rating", "elo_delta", "glicko2_rating", "pagerank_score", "pagerank_delta"),
    "domain_interactions": (
        "sig_strikes_per_min", "striking_accuracy_pct", "td_accuracy_pct", "damage_ratio", "reach_delta", "height_delta", "age_delta", "striking_efficiency_delta",
    ),
}
SIDED = (
    "height_cm", "reach_cm", "age_at_fight", "days_since_last_fight", "fights_last_12mo", "total_ufc_fights", "inactivity_tier", "win_pct_all", "current_streak",
    "finish_rate", "sig_strikes_per_min", "striking_accuracy_pct", "td_accuracy_pct", "damage_ratio",
)
SHARED = ("reach_delta", "height_delta", "age_delta", "striking_efficiency_delta")
#: With those that come from ratings and prestige.
SIDED_RATED = (*SIDED, "elo_rating", "glicko2_rating", "pagerank_score")
SHARED_RATED = (*SHARED, "elo_delta", "pagerank_delta")


def feature_columns(names: list[str]) -> list[str]:
    """What may be a feature: no market and no describing column."""
    return [c for c in names if c not in MARKET and c not in META]


def columns_of(names: list[str], rung: str) -> list[str]:
    order = list(RUNGS)
    parts = [p for r in order[: order.index(rung) + 1] for p in RUNGS[r]]
    return [c for c in feature_columns(names) if any(p in c for p in parts)]


def fight_level(sided: tuple[str, ...] = SIDED, shared: tuple[str, ...] = SHARED) -> Part:
    """One row a bout: features of both sides, those of the pair, the outcome."""
    both = [f"max(CASE WHEN w.side = {i} THEN w.{c} END) AS {c}_{s}" for c in sided for i, s in enumerate("ab")]
    pair = [f"max(CASE WHEN w.side = 0 THEN w.{c} END) AS {c}" for c in shared]
    return "fight_level", lambda d: f"""SELECT w.fight_url, max(w.event_url) AS event_url, max(w.event_date) AS event_date, max(b.a) AS fighter_url_a, max(b.b) AS fighter_url_b, max(b.weight_class) AS weight_class,
  max({OUTCOME}) AS outcome, {columns(both, pair)} FROM wide w JOIN bouts b ON w.fight_url = b.fight_url GROUP BY w.fight_url"""


OUTCOME = "CASE WHEN b.winner = b.a THEN 'win_a' WHEN b.winner = b.b THEN 'win_b' WHEN upper(b.method) LIKE '%DRAW%' THEN 'draw' ELSE 'nc' END"
FIGHT_LEVEL = fight_level()


def matrix(mirrored: bool = False, sided: tuple[str, ...] = SIDED, shared: tuple[str, ...] = SHARED) -> Part:
    """Two rows a decided bout, labels y and 1 - y. As given, both rows have the
    same features; ``mirrored`` swaps the sides in the second instead."""

    def sql(d: Dialect) -> str:
        turn = lambda c, s, t: f"CASE WHEN orientation = 1 THEN {c}_{t} ELSE {c}_{s} END AS {c}_{s}"
        both = [turn(c, s, t) for c in sided for s, t in ("ab", "ba")] if mirrored else [f"{c}_{s}" for c in sided for s in "ab"]
        pair = [f"CASE WHEN orientation = 1 THEN -{c} ELSE {c} END AS {c}" for c in shared] if mirrored else list(shared)
        return f"""SELECT fight_url, event_date, orientation, CAST(CASE WHEN (outcome = 'win_a') = (orientation = 0) THEN 1 ELSE 0 END AS DOUBLE) AS label, {columns(both, pair)}
FROM fight_level {d.sides('orientation')} WHERE outcome IN ('win_a', 'win_b')"""

    return "matrix", sql


MATRIX = matrix()
EXCLUSIONS: Part = ("exclusions", lambda d: f"SELECT {OUTCOME} AS outcome, count(*) AS n FROM bouts b GROUP BY {OUTCOME}")


def _symmetric(d: Dialect) -> str:
    """The pair in the order of its names; a raw score of either order, averaged:
    p = (p(a, b) + 1 - p(b, a)) / 2, so that p(a, b) = 1 - p(b, a). The raw score
    here is a fixed logistic with a bias to the first side."""
    z = lambda s, t: f"(coalesce(win_pct_all_{s}, 0.5) - coalesce(win_pct_all_{t}, 0.5)) * 2 + (coalesce(current_streak_{s}, 0) - coalesce(current_streak_{t}, 0)) / CAST(10 AS DOUBLE) + CAST(0.1 AS DOUBLE)"
    p = lambda s, t: f"1 / (1 + exp(-({z(s, t)})))"
    first = "fighter_url_a <= fighter_url_b"
    return f"""SELECT fight_url, least(fighter_url_a, fighter_url_b) AS canonical_a, greatest(fighter_url_a, fighter_url_b) AS canonical_b,
  round(CASE WHEN {first} THEN ({p('a', 'b')} + 1 - {p('b', 'a')}) / 2 ELSE ({p('b', 'a')} + 1 - {p('a', 'b')}) / 2 END, 9) AS p_canonical FROM fight_level"""


SYMMETRIC: Part = ("symmetric", _symmetric)


class MissingScoreError(ValueError):
    """A contestant of a pair has no score."""


def predicted(fights: DataFrame, score: Callable[[str, str], Column], calibrate: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """fight_url, canonical_a, canonical_b, p_canonical: the pair in the order of
    its names, the raw score of either order averaged, then calibrated once.

    ``score(s, t)`` is the probability that the contestant whose columns end in
    ``_s`` beats the other; a bout for which it is NULL raises."""
    first = F.col("fighter_url_a") <= F.col("fighter_url_b")
    raw = F.when(first, (score("a", "b") + 1 - score("b", "a")) / 2).otherwise((score("b", "a") + 1 - score("a", "b")) / 2)
    told = F.when(raw.isNull(), F.raise_error(F.concat(F.lit(f"{MissingScoreError.__name__}: "), "fight_url")).cast("double")).otherwise(calibrate(raw))
    return fights.select("fight_url", F.least("fighter_url_a", "fighter_url_b").alias("canonical_a"), F.greatest("fighter_url_a", "fighter_url_b").alias("canonical_b"), told.alias("p_canonical"))


def trained(train: DataFrame, test: DataFrame, rung: str = "domain_interactions", rounds: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """fight_url, orientation, label, prob of ``test`` by boosted trees fitted on
    ``train``. The trees know no missing values: each is replaced by 0 and told
    by an indicator."""
    names = columns_of(train.columns, rung)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{c}") for c in names] + [F.col(c).isNull().cast("double").alias(f"m_{c}") for c in names]
    ready = VectorAssembler(inputCols=[f"{k}_{c}" for k in "xm" for c in names], outputCol="features")
    shape = lambda df: ready.transform(df.select("fight_url", "orientation", "label", *filled)).select("fight_url", "orientation", "label", "features")
    model = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed).fit(shape(train))
    return model.transform(shape(test)).select("fight_url", "orientation", "label", vector_to_array("probability")[1].alias("prob"))
