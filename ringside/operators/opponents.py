"""Common opponents weighed by what was known of them before the bout's tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_join

# Rating of who isn't rated yet, and where ratings begin to count. Fixed values.
START, FLOOR, SPAN = 1500.0, 1000.0, 1000.0


def common(bouts: DataFrame, shared: DataFrame, elo: DataFrame, prestige: DataFrame) -> DataFrame:
    """The columns of common opponents for each bout.

    ``shared``: the rows of ``plans.opponents.UNWEIGHED``. ``elo``: (fighter, tick,
    elo), known before each of a contestant's own ticks, and after the last; a
    rating changes at own bouts only, so the first at or after the bout's tick is
    the one before it. ``prestige``: (fighter, tick, score); the last at or before."""
    rows = asof_join(shared.withColumnRenamed("opp", "fighter"), elo, ["fighter"], "tick", ["elo"], forward=True).drop("matched_at")
    rows = asof_join(rows, prestige, ["fighter"], "tick", ["score"]).drop("matched_at")
    rated = F.greatest(F.coalesce("elo", F.lit(START)) - FLOOR, F.lit(0.0)) / SPAN
    rows = rows.withColumn("weight", (0.5 * rated + 0.5 * F.coalesce("score", F.lit(0.0))) * F.col("recency"))
    score = lambda s: F.sum(F.col("weight") * F.coalesce(F.try_divide(f"won_{s}", f"decided_{s}"), F.lit(0.0)))
    rate = lambda s: F.coalesce(F.try_divide(F.sum(f"won_{s}"), F.sum(f"decided_{s}")), F.lit(0.0))
    sums = rows.groupBy("fight_url").agg(
        F.count("*").cast("int").alias("n_common_opponents"), score("a").alias("common_opp_score_a"), score("b").alias("common_opp_score_b"),
        (score("a") - score("b")).alias("common_opp_score_delta"), rate("a").alias("common_opp_a_win_rate"), rate("b").alias("common_opp_b_win_rate"),
    )
    return bouts.select("fight_url").join(sums, "fight_url", "left").withColumn("n_common_opponents", F.coalesce("n_common_opponents", F.lit(0)))
