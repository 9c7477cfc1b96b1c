"""Scores of probabilistic predictions: (doc, event_id, prob, market, label)."""

from __future__ import annotations

from .dialect import Dialect, Part

CLIP = "1e-15"
#: Upper edges of ten equal bins as binary fractions have them, and the fixed reliability buckets. Fixed values.
EDGES = ("0.1", "0.2", "0.30000000000000004", "0.4", "0.5", "0.6000000000000001", "0.7000000000000001", "0.8", "0.9")
BUCKETS = ((0.1, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9))
LOW_SUPPORT = 10


def _dbl(x: object) -> str:
    return f"CAST('{x}' AS DOUBLE)"


def _preds(d: Dialect) -> str:
    return f"""SELECT d.doc_id, d.source AS event_id, d.lang AS candidate, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS prob,
  CAST((d.n_chars * 7 + 13) % 1000 AS DOUBLE) / 1000 AS market, CAST(l.quality AS DOUBLE) AS label
FROM {d.table('documents')} d JOIN {d.table('labels')} l ON d.doc_id = l.doc_id"""


PREDICTIONS: Part = ("preds", _preds)


def squared(p: str = "prob") -> str:
    return f"({p} - label) * ({p} - label)"


def loss(p: str = "prob") -> str:
    c = f"greatest({_dbl(CLIP)}, least(1 - {_dbl(CLIP)}, {p}))"
    return f"-(label * ln({c}) + (1 - label) * ln(1 - {c}))"


def bin_of(p: str = "prob") -> str:
    return "(" + " + ".join(f"CASE WHEN {p} >= {_dbl(e)} THEN 1 ELSE 0 END" for e in EDGES) + ")"


def scores_by(group: str | None) -> Part:
    """Brier, log loss and ECE of all predictions, or of each group."""
    key = group or "'all'"

    def sql(d: Dialect) -> str:
        return f"""SELECT g AS grp, CAST(sum(n) AS BIGINT) AS n, round(sum(sq) / sum(n), 9) AS brier, round(sum(ll) / sum(n), 9) AS log_loss,
  round(sum(abs(sp - sy)) / sum(n), 9) AS ece
FROM (SELECT {key} AS g, {bin_of()} AS b, count(*) AS n, sum({squared()}) AS sq, sum({loss()}) AS ll, sum(prob) AS sp, sum(label) AS sy FROM preds GROUP BY {key + ', ' if group else ''}{bin_of()}) x
GROUP BY g"""

    return "scores", sql


def _reliability(d: Dialect) -> str:
    lower = "CASE " + " ".join(f"WHEN prob >= {_dbl(lo)} AND prob {'<=' if i == len(BUCKETS) - 1 else '<'} {_dbl(hi)} THEN {i}" for i, (lo, hi) in enumerate(BUCKETS)) + " END"
    dim = " UNION ALL ".join(f"SELECT {i} AS b, {_dbl(lo)} AS lower, {_dbl(hi)} AS upper" for i, (lo, hi) in enumerate(BUCKETS))
    return f"""SELECT d.lower, d.upper, CAST(coalesce(s.n, 0) AS BIGINT) AS n_fights, CAST(coalesce(s.k, 0) AS BIGINT) AS n_won, round(coalesce(s.p, 0), 9) AS mean_predicted,
  round(coalesce(s.y, 0), 9) AS observed_win_rate, round(coalesce(abs(s.p - s.y), 0), 9) AS calibration_error, coalesce(s.n, 0) < {LOW_SUPPORT} AS low_support
FROM ({dim}) d LEFT JOIN (SELECT {lower} AS b, count(*) AS n, sum(label) AS k, avg(prob) AS p, avg(label) AS y FROM preds GROUP BY {lower}) s ON d.b = s.b"""


RELIABILITY: Part = ("reliability", _reliability)


def _cumulative(d: Dialect) -> str:
    """Skill 1 - model / market over all events so far, by event."""
    return f"""SELECT event_id, CAST(sum(n) OVER w AS BIGINT) AS n_so_far, round(1 - sum(m) OVER w / nullif(sum(k) OVER w, 0), 9) AS skill
FROM (SELECT event_id, count(*) AS n, sum({squared()}) AS m, sum({squared('market')}) AS k FROM preds GROUP BY event_id) e WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


CUMULATIVE: Part = ("cumulative", _cumulative)


def _mde(d: Dialect) -> str:
    """Least detectable mean difference of squared errors at 5 % and power 0.8."""
    diff = f"({squared()} - {squared('market')})"
    return f"SELECT count(*) AS n, round(avg({diff}), 9) AS mean_difference, round(({_dbl('1.959963984540054')} + {_dbl('0.8416212335729143')}) * stddev_samp({diff}) / sqrt(count(*)), 9) AS mde FROM preds"


MDE: Part = ("mde", _mde)


def _ablation(d: Dialect) -> str:
    """Squared error against the market's, by candidate, as a normal interval; significant where zero is outside."""
    diff = f"({squared()} - {squared('market')})"
    half = f"{_dbl('1.959963984540054')} * stddev_samp({diff}) / sqrt(count(*))"
    return f"""SELECT candidate, n, round(delta, 9) AS delta, round(delta - half, 9) AS ci_lower, round(delta + half, 9) AS ci_upper, (delta - half > 0 OR delta + half < 0) AS significant
FROM (SELECT candidate, count(*) AS n, avg({diff}) AS delta, {half} AS half FROM preds GROUP BY candidate) x"""


ABLATION: Part = ("ablation", _ablation)


def permutation(rounds: int) -> Part:
    """Sign-flip test over events: each round turns the sign of each event's sum
    by a hash of round and event, so every engine draws the same signs."""

    def sql(d: Dialect) -> str:
        diff = f"({squared()} - {squared('market')})"
        draws = "LATERAL VIEW explode(sequence(1, " + str(rounds) + ")) r AS b" if d.name == "spark" else f", range(1, {rounds + 1}) r(b)"
        return f"""SELECT count(*) AS rounds, round(max(seen), 9) AS statistic, round((1 + sum(CASE WHEN abs(drawn) >= abs(seen) - {_dbl('1e-12')} THEN 1 ELSE 0 END)) / CAST(count(*) + 1 AS DOUBLE), 9) AS p_value
FROM (SELECT b, sum(CASE WHEN substr(md5(concat(CAST(b AS VARCHAR(10)), ':', event_id)), 1, 1) < '8' THEN s ELSE -s END) / max(n_all) AS drawn, sum(s) / max(n_all) AS seen
  FROM (SELECT event_id, s, n_all, b FROM (SELECT event_id, sum({diff}) AS s, sum(sum(1)) OVER () AS n_all FROM preds GROUP BY event_id) e {draws}) f GROUP BY b) g"""

    return "permutation", sql


#: Buckets of a calibration artifact: id, bounds, size, error. Fixed values.
ARTIFACT = (("0.1-0.3", 0.1, 0.3, 50, 0.04), ("0.3-0.5", 0.3, 0.5, 80, 0.03), ("0.5-0.7", 0.5, 0.7, 70, 0.05), ("0.7-0.9", 0.7, 0.9, 40, 0.06))


def gate(k: float = 2.0) -> Part:
    """Bucket of the model's probability (a boundary goes to the lower bucket,
    what is outside to the nearest) and whether the mismatch exceeds k errors;
    NO_BUCKET_DATA without a probability, or where nothing was seen in the bucket."""

    def sql(d: Dialect) -> str:
        dim = " UNION ALL ".join(f"SELECT {i} AS b, '{n}' AS bucket_id, {size} AS bucket_n, {_dbl(err)} AS err" for i, (n, _, _, size, err) in enumerate(ARTIFACT))
        of = "CASE WHEN prob IS NULL THEN NULL " + " ".join(f"WHEN prob <= {_dbl(hi)} THEN {i}" for i, (_, _, hi, _, _) in enumerate(ARTIFACT)) + f" ELSE {len(ARTIFACT) - 1} END"
        return f"""SELECT p.doc_id, round(p.prob - p.market, 9) AS mismatch, a.bucket_id, a.bucket_n, CASE WHEN a.b IS NULL OR a.bucket_n = 0 THEN 'NO_BUCKET_DATA' WHEN abs(p.prob - p.market) > {k} * a.err THEN 'FLAGGED' ELSE 'WITHIN_NOISE' END AS verdict
FROM (SELECT *, {of} AS b FROM preds) p LEFT JOIN ({dim}) a ON p.b = a.b"""

    return "gate", sql


def _ranked(d: Dialect) -> str:
    """Candidates by mean Brier, then log loss, then ECE over folds (events)."""
    return f"""SELECT candidate, round(avg(brier), 9) AS mean_brier, round(avg(ll), 9) AS mean_log_loss, round(avg(ece), 9) AS mean_ece,
  CAST(row_number() OVER (ORDER BY avg(brier), avg(ll), avg(ece), candidate) AS BIGINT) AS place
FROM (SELECT candidate, event_id, sum(sq) / sum(n) AS brier, sum(lg) / sum(n) AS ll, sum(abs(sp - sy)) / sum(n) AS ece
  FROM (SELECT candidate, event_id, {bin_of()} AS b, count(*) AS n, sum({squared()}) AS sq, sum({loss()}) AS lg, sum(prob) AS sp, sum(label) AS sy FROM preds GROUP BY candidate, event_id, {bin_of()}) x
  GROUP BY candidate, event_id) f GROUP BY candidate"""


CANDIDATES: Part = ("candidates", _ranked)
