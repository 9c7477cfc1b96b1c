"""Folds, intervals, bootstrap, calibrators, matrix and gate."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from ringside.operators import evaluation as ev
from ringside.operators import model
from ringside.operators.registry import FeatureRegistry, RegistryError, check_version, source_hash, write_manifest
from ringside.plans import evaluation as E
from ringside.plans.dialect import Plan


def index(n, k, start=1996):
    return [(f"e{i:03d}", date(start, 1, 10) + timedelta(days=21 * i), k) for i in range(n)]


def test_folds_expand_in_order_and_do_not_meet():
    events = index(400, 12)
    order = {u: i for i, (u, _, _) in enumerate(events)}
    folds = ev.folds_of(events[::-1])
    assert len(folds) == 4
    for f in folds:
        parts = [[order[u] for u in f[p]] for p in ("train", "calibration", "test")]
        assert all(max(a) < min(b) for a, b in zip(parts, parts[1:], strict=False))
        assert len(f["train"]) * 12 >= 500 and len(f["calibration"]) * 12 >= 250 and len(f["test"]) * 12 >= 150
    assert all(set(a["train"]) < set(b["train"]) for a, b in zip(folds, folds[1:], strict=False))


def test_folds_fall_back_and_refuse():
    assert len(ev.folds_of(index(210, 12))) == 2
    with pytest.raises(ValueError, match="too few"):
        ev.folds_of(index(10, 12))
    with pytest.raises(ev.HoldoutLeakageError):
        ev.folds_of([*index(100, 12), ("h", date(2026, 1, 1), 1)])


# Exact 95 % intervals of k in n. Fixed values.
@pytest.mark.parametrize(("n", "k", "lower", "upper"), [(50, 25, 0.355273036, 0.644726964), (20, 0, 0.0, 0.168433471), (20, 20, 0.831566529, 1.0), (30, 3, 0.021117137, 0.265288458), (0, 0, 0.0, 1.0)])
def test_exact_interval(n, k, lower, upper):
    got = ev.clopper_pearson(np.array([k]), np.array([n]))
    assert got[0][0] == pytest.approx(lower, abs=1e-6) and got[1][0] == pytest.approx(upper, abs=1e-6)


def preds(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.random(n).round(3)
    y = (rng.random(n) < p).astype(float)
    return p, y, [f"e{i % 13:02d}" for i in range(n)], spark.createDataFrame([(i, f"e{i % 13:02d}", float(a), float(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "doc_id long, event_id string, prob double, label double")


def ece(p, y):
    edges = np.linspace(0, 1, 11)
    at = np.minimum(np.searchsorted(edges, p, side="right") - 1, 9)
    return sum(abs(p[at == b].mean() - y[at == b].mean()) * (at == b).sum() for b in range(10) if (at == b).any()) / len(p)


def test_scores(spark):
    p, y, _, df = preds(spark)
    (r,) = Plan((("preds", lambda d: "SELECT * FROM " + d.table("p")), E.scores_by(None))).run(spark, {"p": df}).collect()
    assert r.brier == pytest.approx(((p - y) ** 2).mean(), abs=1e-8) and r.ece == pytest.approx(ece(p, y), abs=1e-8)


def test_bootstrap_matches_a_plain_loop(spark):
    p, y, events, df = preds(spark)
    names, rng, scores = sorted(set(events)), np.random.default_rng(42), []
    ids = np.array(events)
    for _ in range(200):
        take = np.concatenate([np.flatnonzero(ids == names[i]) for i in rng.integers(0, len(names), size=len(names))])
        scores.append((((p - y) ** 2)[take].mean(), ece(p[take], y[take])))
    want = np.percentile(np.array(scores), [2.5, 97.5], axis=0)
    got = {r.metric: r for r in ev.bootstrap(df, rounds=200).collect()}
    assert (got["brier"].lower, got["brier"].upper) == (pytest.approx(want[0, 0]), pytest.approx(want[1, 0]))
    assert (got["ece"].lower, got["ece"].upper) == (pytest.approx(want[0, 1]), pytest.approx(want[1, 1]))
    assert got["brier"].lower <= got["brier"].point <= got["brier"].upper


def test_calibrators(spark):
    *_, fit = preds(spark, 600, 2)
    *_, apply = preds(spark, 300, 3)
    out = ev.calibrated(fit, apply)
    r = out.orderBy("prob").collect()
    for c in ("platt", "beta", "isotonic"):
        v = [x[c] for x in r]
        assert all(0 <= x <= 1 for x in v) and all(a <= b + 1e-9 for a, b in zip(v, v[1:], strict=False))
    best = ev.best_calibrator(out).collect()
    assert [b.method for b in best if b.best] == [min(best, key=lambda b: (b.ece, b.brier)).method]
    with pytest.raises(ValueError, match="calibrate"):
        ev.calibrated(fit.limit(10), apply)


def test_gate_bounds(spark):
    df = spark.createDataFrame([(i, "e", p, 0.5, 1.0) for i, p in enumerate((0.05, 0.3, 0.5, 0.7, 0.95, 0.6))], "doc_id long, event_id string, prob double, market double, label double")
    got = {r.doc_id: r for r in Plan((("preds", lambda d: "SELECT * FROM " + d.table("p")), E.gate())).run(spark, {"p": df}).collect()}
    assert [got[i].bucket_id for i in range(6)] == ["0.1-0.3", "0.1-0.3", "0.3-0.5", "0.5-0.7", "0.7-0.9", "0.5-0.7"]
    assert got[2].verdict == "WITHIN_NOISE" and got[3].verdict == "FLAGGED"


def test_matrix_and_rungs(spark):
    names = ["fight_url", "outcome", "weight_class", "opening_implied_prob", "win_pct_all_a", "height_cm_a", "elo_delta", "reach_delta"]
    assert model.columns_of(names, "naive") == [] and model.columns_of(names, "record") == ["win_pct_all_a"]
    assert model.columns_of(names, "domain_interactions") == ["win_pct_all_a", "height_cm_a", "elo_delta", "reach_delta"]
    cols = [f"{c}_{s}" for c in model.SIDED for s in "ab"] + list(model.SHARED)
    outcomes = ["win_a", "win_b", "draw", "nc"] * 12 + ["win_a", "win_b"]
    fights = spark.createDataFrame([(f"f{i}", "2020-01-01", o, *[float(i + j) for j in range(len(cols))]) for i, o in enumerate(outcomes)], ["fight_url", "event_date", "outcome", *cols])
    source = ("fight_level", lambda d: "SELECT * FROM " + d.table("f"))
    rows = Plan((source, model.MATRIX)).run(spark, {"f": fights}).collect()
    assert len(rows) == 2 * 26
    by = {(r.fight_url, r.orientation): r for r in rows}
    assert all(by[f, 0].label + by[f, 1].label == 1 and by[f, 0].height_cm_a == by[f, 1].height_cm_a for f, _ in by)
    turned = {(r.fight_url, r.orientation): r for r in Plan((source, model.matrix(mirrored=True))).run(spark, {"f": fights}).collect()}
    assert all(turned[f, 0].height_cm_a == turned[f, 1].height_cm_b and turned[f, 0].reach_delta == -turned[f, 1].reach_delta for f, _ in turned)


def test_registry_and_versions(tmp_path):
    r = FeatureRegistry()
    r.register("b", {"x": "float"})
    r.register("a", {"y": "str", "z": "int"})
    assert r.columns() == ["y", "z", "x"] and [f.dataType.simpleString() for f in r.schema()] == ["string", "int", "double"]
    for bad in (("b", {"q": "float"}), ("c", {"x": "float"}), ("d", {"q": "list"})):
        with pytest.raises(RegistryError):
            r.register(*bad)
    with pytest.raises(RegistryError):
        r.require("a", "nope")
    (tmp_path / "m.py").write_text("1")
    digest, at = source_hash(str(tmp_path)), str(tmp_path / "manifest.json")
    with pytest.raises(RegistryError, match="no manifest"):
        check_version(at, 1, digest)
    write_manifest(at, 1, digest)
    check_version(at, 1, digest)
    with pytest.raises(RegistryError, match="version 1"):
        check_version(at, 2, "other")
    (tmp_path / "m.py").write_text("2")
    with pytest.raises(RegistryError, match="without a new version"):
        check_version(at, 1, source_hash(str(tmp_path)))
