"""Evaluation that isn't plain SQL: folds, exact intervals, bootstrap, calibrators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.evaluation import bin_of, loss, squared

CLIP = 1e-7


class HoldoutLeakageError(ValueError):
    """An event of the holdout window was handed to development."""


def folds_of(
    events: list[tuple[str, date, int]], n_folds: int = 4, min_train: int = 500, min_test: int = 150, cal_ratio: float = 0.20,
    cal_min: int = 250, holdout: tuple[date, date] = (date(2026, 1, 1), date(2026, 8, 31)),
) -> list[dict[str, list[str]]]:
    """Expanding folds over (event_url, date, bouts), in time order.

    The timeline is cut into n + 1 stretches; a cut comes as soon as a stretch
    holds its share of bouts and enough events are left for the others. Fold k
    tests on stretch k + 1; of what is before, the last events that reach the
    calibration size calibrate and the rest train. Fewer folds are tried until
    the minima hold.
    """
    for url, day, _ in events:
        if holdout[0] <= day <= holdout[1]:
            raise HoldoutLeakageError(f"{url} of {day} is in the holdout window")
    events = sorted(events, key=lambda e: (e[1], e[0]))
    for n in range(n_folds, 1, -1):
        cuts = _cuts([e[2] for e in events], n + 1)
        folds = cuts and _built(events, cuts, min_train, min_test, cal_ratio, cal_min)
        if folds:
            return folds
    raise ValueError("there are too few bouts for two folds")


def _cuts(sizes: list[int], stretches: int) -> list[int] | None:
    share, held, cuts = sum(sizes) / stretches, 0, [0]
    for i, n in enumerate(sizes):
        held += n
        open_ = stretches - len(cuts)  # stretches after the current one
        if open_ > 0 and held >= share and len(sizes) - i - 1 >= open_:
            cuts.append(i + 1)
            held = 0
    cuts.append(len(sizes))
    return cuts if len(cuts) == stretches + 1 and all(a < b for a, b in zip(cuts, cuts[1:], strict=False)) else None


def _built(events, cuts, min_train, min_test, cal_ratio, cal_min):
    folds = []
    for k in range(len(cuts) - 2):
        before, test = events[: cuts[k + 1]], events[cuts[k + 1] : cuts[k + 2]]
        goal = max(cal_min, math.ceil(cal_ratio * sum(e[2] for e in before)))
        at, held = len(before), 0
        while at > 0 and held < goal:
            at -= 1
            held += before[at][2]
        if sum(e[2] for e in test) < min_test or sum(e[2] for e in before[:at]) < min_train:
            return None
        folds.append({"train": [e[0] for e in before[:at]], "calibration": [e[0] for e in before[at:]], "test": [e[0] for e in test]})
    return folds


def fold_table(spark: SparkSession, events: DataFrame, **how) -> DataFrame:
    """(fold_id, partition, event_url) from event_url, event_date, n_fights. The
    cuts depend on each other in order; events are few beside bouts."""
    rows = [(r["event_url"], r["event_date"], r["n_fights"]) for r in events.collect()]
    out = [(k, part, url) for k, fold in enumerate(folds_of(rows, **how)) for part, urls in fold.items() for url in urls]
    return spark.createDataFrame(out, "fold_id int, partition string, event_url string")


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    x, a, b = (np.asarray(v, dtype=float) for v in (x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lbeta = np.vectorize(lambda s, t: math.lgamma(s) + math.lgamma(t) - math.lgamma(s + t))(p, q)
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - lbeta) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
    value = front * f
    return np.where(swap, 1 - value, value)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(np.asarray(a, dtype=float)), np.ones_like(np.asarray(a, dtype=float))
    for _ in range(100):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def clopper_pearson(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Exact interval of k successes in n; (0, 1) where n is 0."""
    k, n = np.asarray(k, dtype=float), np.asarray(n, dtype=float)
    lower = np.where(k > 0, beta_quantile(alpha / 2, np.maximum(k, 1), n - k + 1), 0.0)
    upper = np.where(k < n, beta_quantile(1 - alpha / 2, k + 1, np.maximum(n - k, 1)), 1.0)
    return np.where(n > 0, lower, 0.0), np.where(n > 0, upper, 1.0)


def with_interval(rows: DataFrame, won: str, n: str) -> DataFrame:
    """Add ci_lower and ci_upper, a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lower, upper = clopper_pearson(pdf[won].to_numpy(), pdf[n].to_numpy())
            yield pdf.assign(ci_lower=lower, ci_upper=upper)

    more = [T.StructField(c, T.DoubleType()) for c in ("ci_lower", "ci_upper")]
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *more]))


def bootstrap(preds: DataFrame, rounds: int = 5000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """metric, point, lower, upper for Brier, log loss and ECE; whole events are drawn.

    Events are reduced to sums (one row each), in order of event_id. All rounds
    come from one generator in turn; a task draws the stream up to its rounds,
    which is cheap, and computes only its own.
    """
    spark = preds.sparkSession
    bins = preds.withColumn("b", F.expr(bin_of()))
    sums = [F.count("*").alias("n"), F.sum(F.expr(squared())).alias("sq"), F.sum(F.expr(loss())).alias("ll")]
    sums += [F.sum(F.when(F.col("b") == i, F.col("prob") - F.col("label")).otherwise(0.0)).alias(f"g{i}") for i in range(10)]
    stats = bins.groupBy("event_id").agg(*sums).orderBy("event_id").drop("event_id").toPandas().to_numpy(dtype=float)  # a row an event
    shared = spark.sparkContext.broadcast(stats)

    def scored(total: np.ndarray) -> np.ndarray:
        n = total[..., 0]
        return np.stack([total[..., 1] / n, total[..., 2] / n, np.abs(total[..., 3:]).sum(axis=-1) / n], axis=-1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats = shared.value
        wanted = {int(b) for pdf in batches for b in pdf["id"]}
        if not wanted or not len(stats):
            return
        rng, out = np.random.default_rng(seed), []
        for b in range(max(wanted) + 1):
            drawn = rng.integers(0, len(stats), size=len(stats))
            if b in wanted:
                out.append(scored(stats[drawn].sum(axis=0)))
        yield pd.DataFrame(out, columns=["brier", "log_loss", "ece"])

    drawn = spark.range(0, rounds, 1, 8).mapInPandas(run, "brier double, log_loss double, ece double")
    names = ("brier", "log_loss", "ece")
    point = scored(stats.sum(axis=0)) if len(stats) else [None] * 3
    cuts = drawn.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*").groupBy("metric").agg(
        F.percentile("v", F.lit(alpha / 2)).alias("lower"), F.percentile("v", F.lit(1 - alpha / 2)).alias("upper")
    )
    known = spark.createDataFrame([(n, float(p) if p is not None else None) for n, p in zip(names, point, strict=True)], "metric string, point double")
    return known.join(cuts, "metric", "left")


def calibrated(fit: DataFrame, apply: DataFrame, guard: int = 250) -> DataFrame:
    """``apply`` with columns platt, isotonic and beta, fitted on ``fit``.

    Platt: logistic regression on the logit; beta: on (ln p, -ln(1 - p)), the
    same likelihood; isotonic: monotone steps, clipped outside. None is
    regularised. Fewer than ``guard`` rows to fit on are refused."""
    n = fit.count()
    if n < guard:
        raise ValueError(f"{n} rows to calibrate on; {guard} are needed")
    p = F.least(F.greatest("prob", F.lit(CLIP)), F.lit(1 - CLIP))

    def ready(df: DataFrame) -> DataFrame:
        return df.withColumn("_logit", array_to_vector(F.array(F.ln(p / (1 - p))))).withColumn("_pair", array_to_vector(F.array(F.ln(p), -F.ln(1 - p))))

    fit = ready(fit).cache()
    logistic = lambda c: LogisticRegression(featuresCol=c, labelCol="label", regParam=0.0, maxIter=1000, tol=1e-10, standardization=False).fit(fit)
    platt, beta = logistic("_logit"), logistic("_pair")
    iso = IsotonicRegression(featuresCol="prob", labelCol="label").fit(fit)
    out = ready(apply)
    for name, model in (("platt", platt), ("beta", beta)):
        out = model.transform(out).withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    out = iso.transform(out).withColumnRenamed("prediction", "isotonic")
    fit.unpersist()
    return out.drop("_logit", "_pair")


def best_calibrator(scored: DataFrame, names: tuple[str, ...] = ("platt", "isotonic", "beta")) -> DataFrame:
    """method, ece, brier, best: the least ECE wins, then the least Brier, then
    the order of ``names``."""
    long = scored.select("label", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("method"), F.col(n).alias("prob")) for i, n in enumerate(names)])).alias("x")).select("label", "x.*")
    bins = long.groupBy("at", "method", F.expr(bin_of()).alias("b")).agg(F.count("*").alias("n"), F.sum("prob").alias("p"), F.sum("label").alias("y"), F.sum(F.expr(squared())).alias("s"))
    total = bins.groupBy("at", "method").agg((F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("s") / F.sum("n")).alias("brier"))
    first = total.agg(F.min(F.struct("ece", "brier", "at"))["at"].alias("won"))
    return total.crossJoin(F.broadcast(first)).select("method", "ece", "brier", (F.col("at") == F.col("won")).alias("best"))
