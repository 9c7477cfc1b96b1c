"""Candidate search: every candidate is fitted and judged on every fold, and the
best by mean scores wins.

Fits don't depend on each other: each (candidate, fold) is a task of its own that
reads the fold's rows, so all run at once. For ``boosted``, second-order boosting of
binned regression trees, the bins' edges are found before (exact quantiles of the
fold's training rows, a column a task), and a fit reads a byte a value; rows that
are alike in all bins are one with counts. Another ``fit`` (any function of arrays
that gives a scorer) gets the fold's raw doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import kept

# The parameters of the twelve candidates, in order. Fixed values.
NAMES = ("n_estimators", "learning_rate", "max_depth", "min_child_weight", "subsample", "colsample_bytree", "reg_alpha", "reg_lambda")
CANDIDATES = (
    (200, 0.05, 4, 3, 0.8, 0.8, 0.0, 1.0),
    (300, 0.03, 5, 5, 0.7, 0.7, 0.1, 2.0),
    (150, 0.08, 3, 1, 0.9, 0.9, 0.0, 0.5),
    (400, 0.02, 6, 5, 0.7, 0.6, 0.5, 3.0),
    (250, 0.04, 4, 2, 0.85, 0.75, 0.05, 1.5),
    (350, 0.025, 5, 4, 0.75, 0.8, 0.2, 2.5),
    (200, 0.06, 3, 2, 0.8, 0.85, 0.0, 0.8),
    (300, 0.035, 6, 3, 0.65, 0.7, 0.3, 2.0),
    (250, 0.045, 5, 3, 0.8, 0.75, 0.1, 1.2),
    (400, 0.02, 4, 5, 0.7, 0.65, 0.5, 4.0),
    (150, 0.07, 4, 1, 0.9, 0.9, 0.0, 0.3),
    (300, 0.03, 5, 4, 0.8, 0.8, 0.15, 1.8),
)
FEWEST, MOST = 8, 20
SEED = 42
BINS = 32
_CUTS = np.linspace(0, 1, BINS)[1:-1]
_CELLS = 1 << 16

Scorer = Callable[[np.ndarray], np.ndarray]
Fit = Callable[[np.ndarray, np.ndarray, dict], Scorer]


class CandidateCountError(ValueError):
    """There are too few candidates to choose from, or too many."""


def params(candidate: int) -> dict:
    return dict(zip(NAMES, CANDIDATES[candidate], strict=True))


def _edges(column: np.ndarray) -> np.ndarray:
    known = column[~np.isnan(column)]
    return np.unique(np.quantile(known, _CUTS)) if len(known) else np.zeros(0)


def _coded(columns: Iterator[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Values as the numbers of their quantile bins, a row for each column;
    missing ones have the last bin."""
    return np.stack([np.where(np.isnan(c), BINS - 1, np.searchsorted(e, c, side="right")).astype(np.uint8) for e, c in zip(edges, columns, strict=True)])


def _histogram(codes: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of g and of h by column and bin: (2, columns, bins)."""
    wide, out = len(codes), np.empty((2, len(codes), BINS))
    values = (g[rows], h[rows])
    step = max(1, _CELLS // max(1, len(rows)))  # a large node's columns one by one
    for at in range(0, wide, step):
        part = codes[at : at + step].take(rows, axis=1)
        n = len(part)
        cell = part[0].astype(np.intp) if n == 1 else (part + np.arange(0, n * BINS, BINS)[:, None]).ravel()
        for o, v in zip(out, values, strict=True):
            o[at : at + n] = np.bincount(cell, weights=v if n == 1 else np.tile(v, n), minlength=n * BINS).reshape(n, BINS)
    return out


def _tree(codes: np.ndarray, g: np.ndarray, h: np.ndarray, allowed: np.ndarray, p: dict) -> dict[int, tuple]:
    """A tree by node number (children of k: 2k + 1, 2k + 2): (value,) or
    (column, bin, whether missing values go left). ``codes`` are those of the
    allowed columns. Sums of g and h must be exact: of two children the one with
    fewer rows is summed, the other is what is left of the parent."""
    pulled = lambda s: np.sign(s) * np.maximum(np.abs(s) - p["reg_alpha"], 0)
    worth = lambda s, w: pulled(s) ** 2 / (w + p["reg_lambda"])
    splits = lambda depth, H: depth < p["max_depth"] and 2 * p["min_child_weight"] <= H
    tree, G, H = {}, g.sum(), h.sum()
    rows = np.arange(len(g))
    todo = [(0, 0, rows, G, H, _histogram(codes, rows, g, h) if splits(0, H) else None)]
    while todo:
        k, depth, rows, G, H, sums = todo.pop()
        best = None
        if sums is not None:
            known, lost = sums[:, :, :-1].cumsum(axis=2), sums[:, :, -1:]
            for left in (True, False):
                gl, hl = known + lost if left else known
                gain = worth(gl, hl) + worth(G - gl, H - hl) - worth(G, H)
                gain[(hl < p["min_child_weight"]) | (H - hl < p["min_child_weight"])] = -np.inf
                column, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[column, cut] > 1e-9 and (best is None or gain[column, cut] > best[0]):
                    best = (gain[column, cut], int(column), int(cut), left, gl[column, cut], hl[column, cut])
        if best is None:
            tree[k] = (-pulled(G) / (H + p["reg_lambda"]),)
            continue
        _, column, cut, left, gl, hl = best
        tree[k] = (int(allowed[column]), cut, left)
        c = codes[column][rows]
        goes = (c <= cut) | (c == BINS - 1) if left else c <= cut
        sides = [(2 * k + 1, rows[goes], gl, hl), (2 * k + 2, rows[~goes], G - gl, H - hl)]
        few, many = sorted(sides, key=lambda s: len(s[1]))
        own, rest = None, None
        if splits(depth + 1, few[3]) or splits(depth + 1, many[3]):
            own = _histogram(codes, few[1], g, h)
            rest = sums - own
        for (child, at, gs, hs), s in ((few, own), (many, rest)):
            todo.append((child, depth + 1, at, gs, hs, s if splits(depth + 1, hs) else None))
    return tree


def _values(tree: dict[int, tuple], codes: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(codes.shape[1]), [(0, np.arange(codes.shape[1]))]
    while todo:
        k, rows = todo.pop()
        if len(tree[k]) == 1:
            out[rows] = tree[k][0]
            continue
        column, cut, left = tree[k]
        c = codes[column][rows]
        goes = (c <= cut) | (c == BINS - 1) if left else c <= cut
        todo += [(2 * k + 1, rows[goes]), (2 * k + 2, rows[~goes])]
    return out


def _grown(codes: np.ndarray, y: np.ndarray, p: dict) -> Scorer:
    """Trees on the gradient and curvature of the log loss; a function from codes
    to probabilities. Neighbours that are alike in all bins are one row with
    counts. Probabilities are rounded so that sums over all rows are exact."""
    rng, (wide, n) = np.random.default_rng(SEED), codes.shape
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    codes = codes[:, starts]
    exact = 2.0 ** (51 - int(n).bit_length())
    score, trees = np.zeros(len(starts)), []
    take = max(1, round(p["colsample_bytree"] * wide))
    for _ in range(p["n_estimators"]):
        prob = 1 / (1 + np.exp(-score))
        curve = np.rint(prob * (1 - prob) * exact) / exact
        prob = np.rint(prob * exact) / exact
        drawn = rng.random(n) < p["subsample"]
        allowed = np.sort(rng.choice(wide, size=take, replace=False))
        times, won = np.add.reduceat(drawn, starts, dtype=np.float64), np.add.reduceat(np.where(drawn, y, 0.0), starts)
        rows = np.flatnonzero(times)
        tree = _tree(codes[allowed[:, None], rows], (times * prob - won)[rows], (times * curve)[rows], allowed, p)
        trees.append(tree)
        score += p["learning_rate"] * _values(tree, codes)

    def scored(new: np.ndarray) -> np.ndarray:
        total = np.zeros(new.shape[1])
        for t in trees:
            total += _values(t, new)
        return 1 / (1 + np.exp(-p["learning_rate"] * total))

    return scored


def boosted(x: np.ndarray, y: np.ndarray, p: dict) -> Scorer:
    """Boosted trees on binned values; a function from rows to probabilities."""
    edges = [_edges(c) for c in x.T]
    scorer = _grown(_coded(x.T, edges), y, p)
    return lambda new: scorer(_coded(new.T, edges))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def platt(prob: np.ndarray, y: np.ndarray) -> Scorer:
    """A logistic curve of the logit, fitted by Newton's method; a step that
    makes the loss greater is halved."""
    logit = lambda q: np.log(np.clip(q, 1e-7, 1 - 1e-7) / (1 - np.clip(q, 1e-7, 1 - 1e-7)))
    z = np.stack([logit(prob), np.ones(len(prob))], axis=1)
    lost = lambda w: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum())
    w = np.zeros(2)
    for _ in range(100):
        q = _logistic(z @ w)
        step = np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + 1e-9 * np.eye(2), z.T @ (y - q))
        while np.abs(step).max() > 1e-12 and lost(w + step) > lost(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return lambda q: _logistic(logit(q) * w[0] + w[1])


def scores(prob: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Brier, log loss, ECE over ten equal bins."""
    q = np.clip(prob, 1e-15, 1 - 1e-15)
    bins = np.minimum((prob * 10).astype(int), 9)
    ece = sum(abs((prob[bins == b] - y[bins == b]).sum()) for b in range(10)) / len(y)
    return float(((prob - y) ** 2).mean()), float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()), float(ece)


def searched(rows: DataFrame, features: list[str], candidates: tuple[int, ...] = tuple(range(len(CANDIDATES))), fit: Fit = boosted) -> DataFrame:
    """candidate, fold_id, n_test, brier, log_loss, ece of every candidate on every
    fold, after calibration. ``rows``: fold_id, partition (train, calibration,
    test), label and the features."""
    if not FEWEST <= len(candidates) <= MOST:
        raise CandidateCountError(f"{len(candidates)} candidates; {FEWEST} to {MOST} are asked for")
    spark, binned = rows.sparkSession, fit is boosted
    plain = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    rows = rows.select(F.col("fold_id").cast("int").alias("fold_id"), "partition", F.col("label").cast("double").alias("label"), *[plain(f) for f in features])
    edges = _edges_by_fold(rows, features) if binned else {}
    # the same draws however the rows came
    order = ["fold_id", *[F.col(f).asc_nulls_last() for f in features], "label"]
    codes = kept(_pieces(rows.repartitionByRange(*order).sortWithinPartitions(*order), features, edges))
    folds = [r["fold_id"] for r in codes.groupBy("fold_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).collect()]  # the longest first
    alone = lambda k, c: codes.where(F.col("fold_id") == k).coalesce(1).withColumn("candidate", F.lit(c))
    wide, chosen = len(features), {c: params(c) for c in candidates}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, job = [], None
        for b in batches:
            for r in b.to_pylist():
                pieces.append((r["part"], r["seq"], r["partition"], r["y"], r["x"]))
                job = (r["candidate"], r["fold_id"])
        if job is None:
            return
        pieces.sort(key=lambda q: q[:2])
        x, y = {}, {}
        for name in ("train", "calibration", "test"):
            mine = [q for q in pieces if q[2] == name]
            pieces = [q for q in pieces if q[2] != name]
            y[name] = np.concatenate([np.zeros(0), *[np.frombuffer(q[3]) for q in mine]])
            kind = np.uint8 if binned else np.float64
            x[name] = np.concatenate([np.zeros((wide, 0), dtype=kind), *[np.frombuffer(q[4], dtype=kind).reshape(wide, -1) for q in mine]], axis=1)
        p = chosen[job[0]]
        if binned:
            scorer = _grown(x.pop("train"), y.pop("train"), p)
        else:
            of_rows = fit(x.pop("train").T, y.pop("train"), p)
            scorer = lambda c: of_rows(c.T)
        curve = platt(scorer(x["calibration"]), y["calibration"])
        found = scores(curve(scorer(x["test"])), y["test"])
        yield pa.RecordBatch.from_pydict(dict(zip(_RESULT.names, ([v] for v in (*job, len(y["test"]), *found)), strict=True)), schema=_RESULT)

    if not folds:
        return spark.createDataFrame([], _RESULT_DDL)
    # a union of single partitions alone would be one task; with rows of another shape (none) each stays a task
    none = codes.where("fold_id IS NULL").withColumn("candidate", F.lit(-1))
    fits = reduce(DataFrame.union, [*[alone(k, c) for k in folds for c in candidates], none])
    return fits.mapInArrow(run, _RESULT_DDL)


_RESULT_DDL = "candidate int, fold_id int, n_test long, brier double, log_loss double, ece double"
_RESULT = pa.schema([("candidate", pa.int32()), ("fold_id", pa.int32()), ("n_test", pa.int64()), *[(c, pa.float64()) for c in ("brier", "log_loss", "ece")]])


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _edges_by_fold(rows: DataFrame, features: list[str]) -> dict[int, list[np.ndarray]]:
    """The edges of each fold's bins, by exact quantiles of its training rows: a
    task holds one column, as distinct values with counts from each batch."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, out = _numbers(b, "fold_id"), []
            for at, f in enumerate(features):
                column = _numbers(b, f).astype(float)
                for k in np.unique(fold).tolist():
                    mine = column[fold == k]
                    values, counts = np.unique(mine[~np.isnan(mine)], return_counts=True)
                    out.append((k, at, values.tobytes(), counts.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["fold_id", "at", "v", "c"])

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.repeat(np.concatenate([np.frombuffer(v) for v in pdf["v"]]), np.concatenate([np.frombuffer(c, dtype=np.int32) for c in pdf["c"]]))
        return pd.DataFrame({"fold_id": pdf["fold_id"].iloc[:1], "at": pdf["at"].iloc[:1], "edges": [_edges(whole).tolist()]})

    packs = rows.where("partition = 'train'").mapInArrow(parts, "fold_id int, at int, v binary, c binary")
    out: dict[int, list[np.ndarray]] = {}
    for r in packs.groupBy("fold_id", "at").applyInPandas(edges, "fold_id int, at int, edges array<double>").collect():  # 30 numbers a column
        out.setdefault(r["fold_id"], [np.zeros(0)] * len(features))[r["at"]] = np.array(r["edges"], dtype=float)
    return out


def _pieces(rows: DataFrame, features: list[str], edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """Rows in their order as pieces: labels, and a row of codes (of doubles, where
    there are no edges) for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for b in batches:
            fold, part, label = _numbers(b, "fold_id"), _numbers(b, "partition"), _numbers(b, "label")
            columns, out = [_numbers(b, f).astype(float) for f in features], []
            for k in np.unique(fold).tolist():
                for name in ("train", "calibration", "test"):
                    mine = np.flatnonzero((fold == k) & (part == name))
                    if len(mine):
                        own = [c[mine] for c in columns]
                        x = _coded(own, edges[k]) if edges else np.stack(own)
                        out.append((k, name, seq, len(mine), label[mine].astype(float).tobytes(), x.tobytes()))
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["fold_id", "partition", "seq", "n", "y", "x"])
            seq += 1

    return rows.mapInArrow(run, "fold_id int, partition string, seq long, n long, y binary, x binary").withColumn("part", F.spark_partition_id())


def ranked(results: DataFrame) -> DataFrame:
    """candidate, mean scores and place: by mean Brier, then log loss, then ECE,
    then the order of the candidates. A row a candidate."""
    means = results.groupBy("candidate").agg(F.count("*").alias("folds"), *[F.avg(c).alias(f"mean_{c}") for c in ("brier", "log_loss", "ece")])
    order = Window.orderBy("mean_brier", "mean_log_loss", "mean_ece", "candidate")  # 20 rows at most
    return means.withColumn("place", F.row_number().over(order))


def refitted(rows: pd.DataFrame, features: list[str], candidate: int, fit: Fit = boosted) -> Scorer:
    """The chosen candidate on all rows."""
    rows = rows.sort_values([*features, "label"], kind="stable")
    return fit(rows[features].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float), params(candidate))
