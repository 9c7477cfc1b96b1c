"""A fit of the search holds a byte a value, and gives what the plain fit gives."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringside.operators import search

NAMES = list("abcde")


def table(n, seed=0, wide=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, wide))
    x[:, 1] = np.round(x[:, 1])
    x[rng.random((n, wide)) < 0.1] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(-np.nan_to_num(x[:, 0])))).astype(float)
    return x, y


def test_a_fit_needs_little_beside_its_values():
    x, y = table(60_000, wide=40)
    tracemalloc.start()
    scorer = search.boosted(x, y, {**search.params(3), "n_estimators": 2})
    scorer(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes


@pytest.mark.parametrize("raw", [False, True])
def test_search_is_the_plain_fit_on_every_fold(spark, monkeypatch, raw):
    x, y = table(900)
    x, y = np.repeat(x, 2, axis=0), np.stack([y, 1 - y], axis=1).ravel()  # pairs of equal rows, as in the matrix
    y[::7] = 1
    few = tuple((20, *c[1:]) for c in search.CANDIDATES[:8])
    monkeypatch.setattr(search, "CANDIDATES", few)
    pdf = pd.DataFrame(x, columns=NAMES).assign(label=y, at=np.arange(len(y)) * 7919 % 1800)
    pdf = pdf.sample(frac=1, random_state=1)
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in NAMES) + ", label double, at long").repartition(3)
    rows = rows.withColumn("fold_id", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("partition", F.when(F.col("at") % 5 == F.col("fold_id"), "test").when(F.col("at") % 5 == 4, "calibration").otherwise("train"))
    fit = (lambda x, y, p: search.boosted(x, y, {**p, "n_estimators": 20})) if raw else search.boosted
    results = search.searched(rows, NAMES, candidates=tuple(range(8)), fit=fit)
    assert results.rdd.getNumPartitions() >= 16  # each fit is a task of its own
    got = {(r.candidate, r.fold_id): r for r in results.collect()}
    assert len(got) == 16
    pdf = pdf.sort_values([*NAMES, "label"], kind="stable")
    for (c, k), r in got.items():
        at = pdf["at"] % 5
        part = lambda m: (pdf[m][NAMES].to_numpy(), pdf[m]["label"].to_numpy())  # noqa: E731, B023
        scorer = search.boosted(*part((at != k) & (at != 4)), {**search.params(c), "n_estimators": 20})
        (cx, cy), (tx, ty) = part(at == 4), part(at == k)
        curve = search.platt(scorer(cx), cy)
        want = search.scores(curve(scorer(tx)), ty)
        assert r.n_test == len(ty) and (r.brier, r.log_loss, r.ece) == pytest.approx(want, abs=1e-9)
