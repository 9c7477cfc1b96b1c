"""Folds, metrics, reliability, calibration, matrix, training and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as op
from ..operators import model, search
from ..operators.lineage import kept, packed
from ..plans import evaluation as E
from ..plans import features as feats
from ..plans.bouts import FIGHTERS_FROM_SALES, FROM_SALES
from ..plans.dialect import Duck, Plan
from ..plans.replay import REPLAY
from . import apart
from .base import Registry, tables
from .ratings import rated_pairs

_r = Registry()
_PREDS = Plan((E.PREDICTIONS,))
_DOCS = ("documents", "labels")
SALES = ("lineitem", "orders", "customer")

_r.plan("eval_scores", _PREDS.then(E.scores_by(None)), *_DOCS)
_r.plan("eval_scores_by_event", _PREDS.then(E.scores_by("event_id")), *_DOCS)
_r.plan("eval_reliability", _PREDS.then(E.RELIABILITY), *_DOCS)
_r.plan("eval_cumulative_skill", _PREDS.then(E.CUMULATIVE), *_DOCS)
_r.plan("eval_mde", _PREDS.then(E.MDE), *_DOCS)
_r.plan("eval_ablation", _PREDS.then(E.ABLATION), *_DOCS)
_r.plan("eval_permutation", _PREDS.then(E.permutation(1000)), *_DOCS)
_r.plan("gate", _PREDS.then(E.gate()), *_DOCS)
_r.plan("candidate_rank", _PREDS.then(E.CANDIDATES), *_DOCS)


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _PREDS.then(("out", lambda d: "SELECT * FROM preds")).run(spark, tables(spark, sf_dir, *_DOCS))


def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _PREDS.then(E.RELIABILITY).run(spark, tables(spark, sf_dir, *_DOCS))
    rows = op.with_interval(rows, "n_won", "n_fights")
    return rows.withColumns({c: F.round(c, 9) for c in ("ci_lower", "ci_upper")})


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bootstrap(_preds(spark, sf_dir))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrators fitted on even documents, judged on odd ones."""
    preds = _preds(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    return op.best_calibrator(op.calibrated(preds.where(even), preds.where(~even), guard=20))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = FROM_SALES.then(("out", lambda d: "SELECT event_url, event_date, CAST(count(*) AS INT) AS n_fights FROM bouts GROUP BY event_url, event_date"))
    return op.fold_table(spark, plan.run(spark, tables(spark, sf_dir, *SALES)))


_r.add("clopper_pearson", clopper_pearson, apart.SQL["clopper_pearson"])
_r.add("bootstrap_ci", bootstrap_ci)
_r.add("calibration", calibration)
_r.add("folds", folds, apart.SQL["folds"])

_WIDE = FROM_SALES.then(FIGHTERS_FROM_SALES, *REPLAY, *feats.FRAME_ALL, feats.wide_part(6))
_r.plan("model_matrix", _WIDE.then(model.FIGHT_LEVEL, model.MATRIX), *SALES, "supplier")
_r.plan("model_exclusions", FROM_SALES.then(model.EXCLUSIONS), *SALES)


def symmetric_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic score with a bias to the first side, handed to the operator."""
    level = _WIDE.then(model.FIGHT_LEVEL, ("out", lambda d: "SELECT * FROM fight_level")).run(spark, tables(spark, sf_dir, *SALES, "supplier"))
    known = lambda c, other: F.coalesce(F.col(c), F.lit(other))

    def score(s: str, t: str):
        z = (known(f"win_pct_all_{s}", 0.5) - known(f"win_pct_all_{t}", 0.5)) * 2 + (known(f"current_streak_{s}", 0.0) - known(f"current_streak_{t}", 0.0)) / 10 + 0.1
        return 1 / (1 + F.exp(-z))

    rows = model.predicted(level, score)
    return rows.withColumn("p_canonical", F.round("p_canonical", 9))


_r.add("symmetric_inference", symmetric_inference, _WIDE.then(model.FIGHT_LEVEL, model.SYMMETRIC).text(Duck()))


def _rated_matrix(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The training matrix with ratings and prestige: two rows a decided bout, as
    ``model.matrix`` gives them. ``more``: further columns of the bout."""
    pairs = rated_pairs(spark, sf_dir, model.SIDED_RATED, model.SHARED_RATED, ("event_date", *more)).where("result is not null")
    rows = pairs.withColumn("orientation", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("event_date", F.col("event_date").cast("string"))
    label = ((F.col("result") == 1) == (F.col("orientation") == 0)).cast("double").alias("label")
    both = [f"{c}_{s}" for c in model.SIDED_RATED for s in "ab"]
    return rows.select("fight_url", "event_date", "orientation", label, *both, *model.SHARED_RATED, *more)


def rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the rated matrix by rung."""
    names = [f"{c}_{s}" for c in model.SIDED_RATED for s in "ab"] + list(model.SHARED_RATED)
    return spark.createDataFrame([(r, c) for r in model.RUNGS for c in model.columns_of(names, r)], "rung string, column_name string")


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on bouts before 2000, scored on the rest."""
    rows = packed(_rated_matrix(spark, sf_dir))
    return model.trained(rows.where("event_date < '2000-01-01'"), rows.where("event_date >= '2000-01-01'"))


def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve candidates on all folds of the rated matrix, ranked."""
    rows = _rated_matrix(spark, sf_dir)
    plan = FROM_SALES.then(("out", lambda d: "SELECT fight_url, event_url, event_date FROM bouts"))
    bouts = kept(plan.run(spark, tables(spark, sf_dir, *SALES)))
    events = bouts.groupBy("event_url", "event_date").agg(F.count("*").cast("int").alias("n_fights"))
    names = model.columns_of(rows.columns, "domain_interactions")
    dated = packed(rows.select("fight_url", "label", *names).join(bouts.select("fight_url", "event_url"), "fight_url").drop("fight_url"))
    parts = dated.join(F.broadcast(op.fold_table(spark, events)), "event_url")
    out = search.ranked(kept(search.searched(parts, names)))
    return out.select("candidate", "folds", *[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in ("brier", "log_loss", "ece")], "place")


_r.add("model_search", model_search)
_r.add("model_matrix_rated", lambda spark, sf_dir: _rated_matrix(spark, sf_dir))
_r.add("model_rungs", rungs, apart.SQL["model_rungs"])
_r.add("model_trained", trained)

QUERIES, SQL = _r.queries, _r.sql
