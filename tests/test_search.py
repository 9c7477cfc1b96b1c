"""Boosted trees, calibration, candidate ranking and symmetric prediction."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringside.operators import model, search


def data(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] + np.where(x[:, 1] > 0, 1.5, -1.5))))
    x[rng.random((n, 4)) < 0.1] = np.nan
    return x, (rng.random(n) < p).astype(float)


def test_one_split_is_the_plain_best():
    """Depth 1, no sampling: the first tree is the best of all splits."""
    x = np.array([[1.0], [2.0], [3.0], [4.0], [np.nan]])
    y = np.array([0.0, 0.0, 1.0, 1.0, 1.0])
    p = dict(n_estimators=1, learning_rate=1.0, max_depth=1, min_child_weight=0, subsample=1.1, colsample_bytree=1.0, reg_alpha=0.0, reg_lambda=1.0)
    got = search.boosted(x, y, p)(x)
    low, high = -(2 * 0.5) / (2 * 0.25 + 1), 3 * 0.5 / (3 * 0.25 + 1)
    assert got == pytest.approx(1 / (1 + np.exp(-np.array([low, low, high, high, high]))))


def test_trees_learn_and_calibrate():
    x, y = data()
    scorer = search.boosted(x[:800], y[:800], search.params(2))
    raw = scorer(x[800:])
    assert search.scores(raw, y[800:])[0] < 0.17 < 0.24 < search.scores(np.full(400, 0.5), y[800:])[0] + 0.01
    curve = search.platt(raw**3, y[800:])
    assert search.scores(curve(raw**3), y[800:])[1] < search.scores(raw**3, y[800:])[1]


def test_search_ranks_by_mean_scores(spark):
    x, y = data(500)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(label=y, at=range(500))
    rows = spark.createDataFrame(pdf).withColumn("fold_id", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("partition", F.when(F.col("at") % 5 == F.col("fold_id"), "test").when(F.col("at") % 5 == 4, "calibration").otherwise("train"))
    constant = lambda x, y, p: lambda new: np.full(len(new), 0.5 + p["learning_rate"])
    fit = lambda x, y, p: search.boosted(x, y, {**p, "n_estimators": 20}) if p["max_depth"] == 4 else constant(x, y, p)
    results = search.searched(rows, list("abcd"), fit=fit).toPandas()
    assert len(results) == 24 and (results["n_test"] == 100).all()
    ranked = search.ranked(spark.createDataFrame(results)).orderBy("place").toPandas()
    means = results.groupby("candidate")[["brier", "log_loss", "ece"]].mean().reset_index().sort_values(["brier", "log_loss", "ece", "candidate"])
    assert ranked["candidate"].tolist() == means["candidate"].tolist() and search.params(ranked["candidate"][0])["max_depth"] == 4
    with pytest.raises(search.CandidateCountError):
        search.searched(rows, list("abcd"), candidates=(1, 2))
    whole = search.refitted(pdf, list("abcd"), 2, fit=fit)(x)
    assert whole.shape == (500,)


def test_symmetric_prediction(spark):
    df = spark.createDataFrame([("f", "x", "y", 0.9, 0.3), ("g", "y", "x", 0.3, 0.9)], "fight_url string, fighter_url_a string, fighter_url_b string, v_a double, v_b double")
    got = {r.fight_url: r for r in model.predicted(df, lambda s, t: F.col(f"v_{s}"), lambda p: p * p).collect()}
    assert got["f"].p_canonical == got["g"].p_canonical == pytest.approx(((0.9 + 1 - 0.3) / 2) ** 2) and got["g"].canonical_a == "x"
    with pytest.raises(Exception, match="MissingScoreError: [fg]"):
        model.predicted(df.withColumn("v_a", F.lit(None).cast("double")), lambda s, t: F.col(f"v_{s}")).collect()
