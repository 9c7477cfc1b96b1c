"""SQL for DuckDB that is written apart from the operators it checks: ratings
bout by bout, prestige at many ticks, folds by prefix sums, exact intervals by binomial sums, rungs."""

from __future__ import annotations

from ..operators import model
from ..plans import evaluation as E
from ..plans.bouts import FROM_SALES
from ..plans.dialect import Duck, Plan
from ..plans.opponents import UNWEIGHED
from ..plans.replay import RECORD_ONLY

_BOUTS = "WITH RECURSIVE " + FROM_SALES.then(("out", lambda d: "SELECT 1")).text(Duck()).removeprefix("WITH ").removesuffix("\nSELECT 1")


def _walk(where: str, start: str, record: str, layers: tuple[str, ...], a: str, b: str) -> str:
    """``walk``: a row a bout, in order, with the records of all contestants
    after it. ``layers`` add columns to the bout and both records before it."""
    inner = f"SELECT s.*, p.state, coalesce(p.state[s.a], {start}) AS x, coalesce(p.state[s.b], {start}) AS y FROM walk p JOIN steps s ON s.i = p.i + 1"
    for at, layer in enumerate(layers):
        inner = f"SELECT *, {layer} FROM ({inner}) l{at}"
    return f"""steps AS MATERIALIZED (SELECT row_number() OVER (ORDER BY tick, fight_url) AS i, * FROM bouts WHERE {where}),
walk(i, state, a, b, ra, rb) AS (
  SELECT 0::BIGINT, MAP {{}}::MAP(VARCHAR, {record}), ''::VARCHAR, ''::VARCHAR, NULL::{record}, NULL::{record}
  UNION ALL
  SELECT i, map_concat(state, MAP {{a: ra, b: rb}}), a, b, ra, rb FROM (SELECT *, {a}::{record} AS ra, {b}::{record} AS rb FROM ({inner}) z) w),
after AS (SELECT w.i, s.tick, unnest([w.a, w.b]) AS fighter, unnest([w.ra, w.rb]) AS v FROM walk w JOIN steps s ON s.i = w.i),
sides AS (SELECT fight_url, tick, unnest([a, b]) AS fighter FROM bouts)"""


def _decayed(s: str) -> str:
    return f"1500 + ({s}.r - 1500) * CASE WHEN day - {s}.d > 180 THEN pow(0.9::DOUBLE, (day - {s}.d) / 180::DOUBLE) ELSE 1 END"


_ELO_K = """CASE WHEN regexp_matches(lower(method), 'could not continue|doctor''s stoppage|overturned - injury|injury.*stoppage|doctor.*stoppage|stoppage.*injury|stoppage.*doctor') THEN 0::DOUBLE
  WHEN regexp_matches(lower(method), 'dq|disqualification') THEN 3.2 WHEN method ILIKE '%ko%' THEN 44.8 WHEN method ILIKE '%sub%' THEN 41.6 ELSE 32 END"""

_ELO = f"""{_walk(
    "true", "struct_pack(r := 1500::DOUBLE, d := day)", "STRUCT(r DOUBLE, d BIGINT)",
    (f"{_decayed('x')} AS ia, {_decayed('y')} AS ib",
     f"{_ELO_K} * (CASE WHEN winner IS NULL THEN 0.5::DOUBLE WHEN winner = a THEN 1 ELSE 0 END - 1 / (1 + pow(10::DOUBLE, (ib - ia) / 400))) AS gain"),
    "struct_pack(r := ia + gain, d := day)", "struct_pack(r := ib - gain, d := day)",
)},
own AS (SELECT fighter, tick, max(i) AS i FROM after GROUP BY fighter, tick),
trail AS (SELECT fighter, i, v.r AS r, greatest(max(v.r) OVER w, 1500) AS top, (2 * (v.r - lag(v.r, 4) OVER w) + lag(v.r, 1) OVER w - lag(v.r, 3) OVER w) / 10 AS slope
  FROM after WINDOW w AS (PARTITION BY fighter ORDER BY i)),
known AS (SELECT o.fighter, o.tick, lag(t.r) OVER w AS r, lag(t.top) OVER w AS top, lag(t.slope) OVER w AS slope
  FROM own o JOIN trail t ON t.fighter = o.fighter AND t.i = o.i WINDOW w AS (PARTITION BY o.fighter ORDER BY o.tick))
SELECT s.fight_url, s.fighter, s.tick, r, top, r / top AS share, slope FROM sides s JOIN known k ON k.fighter = s.fighter AND k.tick = s.tick"""
_ELO_COLUMNS = "round(r, 6) AS elo_rating, round(top, 6) AS elo_peak, round(share, 6) AS elo_current_vs_peak, round(slope, 6) AS elo_trajectory_last5"
ELO = f"{_BOUTS},\nelo AS (WITH RECURSIVE {_ELO})\nSELECT fight_url, fighter, {_ELO_COLUMNS} FROM elo"

_SCALE = "(400 / ln(10::DOUBLE))"


def _surprise(x: str, n: str) -> str:
    """What must vanish at the logarithm of the new variance."""
    room = f"(pow(phi{n}, 2) + v{n} + exp({x}))"
    return f"(exp({x}) * (pow(delta{n}, 2) - {room}) / (2 * pow({room}, 2)) - ({x} - goal{n}) / 0.25)"


def _glicko(n: str, s: str, o: str, score: str) -> tuple[str, ...]:
    """Layers that update record ``s`` against ``o``; the result is ``new{n}``."""
    step = (
        f"list_transform([t.l + (t.l - t.h) * t.fl / (t.fh - t.fl)], lambda q: list_transform([{_surprise('q', n)}], lambda f: "
        "struct_pack(l := CASE WHEN f * t.fh <= 0 THEN t.h ELSE t.l END, h := q, fl := CASE WHEN f * t.fh <= 0 THEN t.fh ELSE t.fl / 2 END, fh := f))[1])[1]"
    )
    ends = f"struct_pack(l := goal{n}, h := high{n}, fl := {_surprise(f'goal{n}', n)}, fh := {_surprise(f'high{n}', n)})"
    below = f"goal{n} - 0.5 * list_filter(range(1, 100), lambda k: {_surprise(f'(goal{n} - 0.5 * k)', n)} >= 0)[1]"
    return (
        f"({s}.r - 1500) / {_SCALE} AS mu{n}, {s}.rd / {_SCALE} AS phi{n}, ({o}.r - 1500) / {_SCALE} AS muo{n}, 1 / sqrt(1 + 3 * pow({o}.rd / {_SCALE} / pi(), 2)) AS g{n}, ln(pow({s}.sigma, 2)) AS goal{n}",
        f"1 / (1 + exp(-g{n} * (mu{n} - muo{n}))) AS e{n}, ({score})::DOUBLE AS score{n}",
        f"1 / (pow(g{n}, 2) * e{n} * (1 - e{n})) AS v{n}",
        f"v{n} * g{n} * (score{n} - e{n}) AS delta{n}",
        f"CASE WHEN pow(delta{n}, 2) - pow(phi{n}, 2) - v{n} > 0 THEN ln(pow(delta{n}, 2) - pow(phi{n}, 2) - v{n}) ELSE {below} END AS high{n}",
        f"{ends} AS ends{n}",
        f"exp(list_reduce(list_transform(range(40), lambda k: ends{n}), lambda t, k: CASE WHEN abs(t.h - t.l) > 1e-6 THEN {step} ELSE t END).h / 2) AS sigma{n}",
        f"1 / sqrt(1 / (pow(phi{n}, 2) + pow(sigma{n}, 2)) + 1 / v{n}) AS after{n}",
        f"struct_pack(r := (mu{n} + pow(after{n}, 2) * g{n} * (score{n} - e{n})) * {_SCALE} + 1500, rd := after{n} * {_SCALE}, sigma := sigma{n}, d := day) AS new{n}",
    )


def _idle(s: str) -> str:
    return f"struct_pack(r := {s}.r, rd := least(sqrt(pow({s}.rd / {_SCALE}, 2) + (day - {s}.d) / 180::DOUBLE * pow({s}.sigma, 2)) * {_SCALE}, 350), sigma := {s}.sigma, d := {s}.d)"


_GLICKO2 = f"""{_walk(
    "winner IS NOT NULL AND NOT regexp_matches(lower(method), 'could not continue|injury|doctor''s stoppage|nc|no contest|overturned')",
    "struct_pack(r := 1500::DOUBLE, rd := 350::DOUBLE, sigma := 0.06::DOUBLE, d := day)", "STRUCT(r DOUBLE, rd DOUBLE, sigma DOUBLE, d BIGINT)",
    (f"{_idle('x')} AS xi, {_idle('y')} AS yi", *_glicko("1", "xi", "yi", "winner = a"), *_glicko("2", "yi", "new1", "winner <> a")),
    "new1", "new2",
)},
own AS (SELECT fighter, tick, max_by(v, i) AS v FROM after GROUP BY fighter, tick)
SELECT s.fight_url, s.fighter, round(coalesce(o.v.r, 1500), 6) AS glicko2_rating, round(coalesce(o.v.rd, 350), 6) AS glicko2_rd
FROM sides s ASOF LEFT JOIN own o ON o.fighter = s.fighter AND s.tick > o.tick"""
GLICKO2 = f"{_BOUTS},\n{_GLICKO2}"

#: Prestige at the first tick of each 365 days and after the last; each graph stops by itself.
_PRESTIGE = """asked AS (SELECT min(tick) AS as_of FROM bouts GROUP BY floor(day / 365) UNION SELECT max(tick) + 1 FROM bouts),
seen AS MATERIALIZED (SELECT q.as_of, b.* FROM bouts b JOIN asked q ON b.tick < q.as_of),
nodes AS (SELECT DISTINCT as_of, unnest([a, b]) AS node FROM seen),
latest AS (SELECT as_of, max(day) AS ref FROM seen WHERE winner IS NOT NULL GROUP BY as_of),
edges AS MATERIALIZED (SELECT as_of, CASE WHEN winner = a THEN b ELSE a END AS src, winner AS dst,
  sum((1::DOUBLE + CASE method WHEN 'KO/TKO' THEN 0.3 WHEN 'Submission' THEN 0.2 ELSE 0 END + CASE WHEN ending_round <= 2 THEN 0.1 ELSE 0 END) * exp(-0.3::DOUBLE * (ref - day) / 365.25::DOUBLE)) AS w
  FROM seen JOIN latest USING (as_of) WHERE winner IS NOT NULL GROUP BY ALL),
share AS MATERIALIZED (SELECT as_of, src, dst, w / sum(w) OVER (PARTITION BY as_of, src) AS p FROM edges),
start AS (SELECT as_of, node, count(*) OVER (PARTITION BY as_of)::DOUBLE AS n, NOT EXISTS (FROM edges e WHERE e.as_of = s.as_of AND e.src = s.node) AS dangling FROM nodes s),
ranks(step, as_of, node, n, dangling, x, moved) AS (
  SELECT 0, as_of, node, n, dangling, 1 / n, n FROM start
  UNION ALL
  SELECT step + 1, as_of, node, n, dangling, new, sum(abs(new - x)) OVER (PARTITION BY as_of)
  FROM (SELECT r.*, 0.85::DOUBLE * (coalesce(f.f, 0) + sum(CASE WHEN r.dangling THEN r.x ELSE 0 END) OVER (PARTITION BY r.as_of) / r.n) + 0.15::DOUBLE / r.n AS new
    FROM ranks r LEFT JOIN (SELECT s.as_of, s.dst, sum(q.x * s.p) AS f FROM ranks q JOIN share s ON s.as_of = q.as_of AND s.src = q.node GROUP BY ALL) f ON f.as_of = r.as_of AND f.dst = r.node
    WHERE r.step < 100 AND r.moved >= r.n * 1e-6) z),
last_ AS (SELECT as_of, max(step) AS step FROM ranks GROUP BY as_of),
prestige AS (SELECT as_of, node, CASE WHEN EXISTS (FROM edges e WHERE e.as_of = r.as_of AND r.node IN (e.src, e.dst)) THEN x ELSE min(x) OVER (PARTITION BY as_of) END AS score
  FROM ranks r JOIN last_ USING (as_of, step))
SELECT as_of, node, score FROM prestige"""
PAGERANK_TICKS = f"{_BOUTS},\nprestige AS (WITH RECURSIVE {_PRESTIGE})\nSELECT as_of, node, round(score, 6) AS score FROM prestige"

#: The graph family from the three above; a contestant's rating changes at own bouts only, so the next own bout tells it.
EMIT_GRAPH = f"""{_BOUTS},
elo AS MATERIALIZED (WITH RECURSIVE {_ELO}),
ends AS MATERIALIZED (WITH RECURSIVE {_ELO.split(",\nown AS (")[0]} SELECT fighter, tick, max_by(v.r, i) AS r FROM after GROUP BY fighter, tick),
glicko AS (WITH RECURSIVE {_GLICKO2}),
prestige AS MATERIALIZED (WITH RECURSIVE {_PRESTIGE}),
shared AS MATERIALIZED ({Plan((*RECORD_ONLY, *UNWEIGHED)).text(Duck())}),
rated AS (SELECT s.*, greatest(coalesce(e.r, 1500) - 1000, 0) / 1000 AS elo FROM shared s ASOF LEFT JOIN ends e ON e.fighter = s.opp AND s.tick > e.tick),
weighed AS (SELECT s.*, (0.5::DOUBLE * s.elo + 0.5::DOUBLE * coalesce(p.score, 0)) * recency AS w FROM rated s ASOF LEFT JOIN prestige p ON p.node = s.opp AND s.tick >= p.as_of),
common AS (SELECT fight_url, count(*) AS n, sum(w * coalesce(won_a / nullif(decided_a, 0)::DOUBLE, 0)) AS sa, sum(w * coalesce(won_b / nullif(decided_b, 0)::DOUBLE, 0)) AS sb,
    coalesce(sum(won_a) / nullif(sum(decided_a), 0)::DOUBLE, 0) AS ra, coalesce(sum(won_b) / nullif(sum(decided_b), 0)::DOUBLE, 0) AS rb FROM weighed GROUP BY fight_url),
rows_ AS (SELECT fight_url, tick, unnest([0, 1]) AS side, unnest([a, b]) AS fighter FROM bouts)
SELECT s.fight_url, s.side, {_ELO_COLUMNS}, glicko2_rating, glicko2_rd, round(s.score, 6) AS pagerank_score, coalesce(n, 0)::INT AS n_common_opponents,
  round(if(side = 0, sa, sb), 6) AS common_opp_score_a, round(if(side = 0, sb, sa), 6) AS common_opp_score_b, round(if(side = 0, sa - sb, sb - sa), 6) + 0 AS common_opp_score_delta,
  round(if(side = 0, ra, rb), 6) AS common_opp_a_win_rate, round(if(side = 0, rb, ra), 6) AS common_opp_b_win_rate
FROM (SELECT r.*, q.score FROM rows_ r ASOF LEFT JOIN prestige q ON q.node = r.fighter AND r.tick >= q.as_of) s
LEFT JOIN (SELECT DISTINCT * FROM elo) e ON e.fight_url = s.fight_url AND e.fighter = s.fighter
LEFT JOIN (SELECT DISTINCT * FROM glicko) g ON g.fight_url = s.fight_url AND g.fighter = s.fighter
LEFT JOIN common c ON c.fight_url = s.fight_url"""

#: Folds by prefix sums: the cuts of each number of folds, one a step; then the largest number whose folds are all large enough.
FOLDS = f"""{_BOUTS},
events_ AS MATERIALIZED (SELECT event_url, i, n, sum(n) OVER (ORDER BY i) - n AS done, sum(n) OVER () AS total, count(*) OVER () AS many
  FROM (SELECT event_url, row_number() OVER (ORDER BY event_date, event_url) - 1 AS i, count(*) AS n FROM bouts GROUP BY event_url, event_date) e),
cuts(folds, j, cut) AS (
  SELECT folds, 0::BIGINT, 0::BIGINT FROM unnest([2, 3, 4]) f(folds)
  UNION ALL
  SELECT c.folds, c.j + 1, min(e.i) + 1 FROM cuts c JOIN events_ b ON b.i = c.cut
    JOIN events_ e ON e.i >= c.cut AND e.done + e.n - b.done >= e.total / (c.folds + 1) AND e.many - e.i - 1 >= c.folds - c.j
  WHERE c.j < c.folds GROUP BY c.folds, c.j),
bounds AS (SELECT * FROM cuts UNION ALL SELECT folds, folds + 1, many FROM unnest([2, 3, 4]) f(folds), (SELECT any_value(many) AS many FROM events_) m),
fold AS (SELECT s.folds, s.j - 1 AS fold_id, s.cut AS starts, t.cut AS stops, greatest(250, ceil(0.20::DOUBLE * sum(e.n))) AS goal, sum(e.n) AS before
  FROM bounds s JOIN bounds t ON t.folds = s.folds AND t.j = s.j + 1 JOIN events_ e ON e.i < s.cut WHERE s.j >= 1 GROUP BY ALL),
part AS (SELECT f.folds, f.fold_id, e.event_url, e.n,
    CASE WHEN e.i >= f.starts THEN 'test' WHEN f.before - e.done - e.n < f.goal THEN 'calibration' ELSE 'train' END AS partition
  FROM fold f JOIN events_ e ON e.i < f.stops),
fits AS (SELECT folds FROM (SELECT folds, fold_id, coalesce(sum(n) FILTER (partition = 'train'), 0) AS train, coalesce(sum(n) FILTER (partition = 'test'), 0) AS test FROM part GROUP BY folds, fold_id) s
  GROUP BY folds HAVING count(*) = folds AND min(train) >= 500 AND min(test) >= 150)
SELECT fold_id::INT AS fold_id, partition, event_url FROM part WHERE folds = (SELECT max(folds) FROM fits)"""


def _tail(first: str, last: str, p: str) -> str:
    return (
        f"list_sum(list_transform(range({first}, {last} + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"
    )


#: Shares at which each tail of the binomial distribution holds 0.025, by halving.
CLOPPER_PEARSON = f"""WITH RECURSIVE {Plan((E.PREDICTIONS, E.RELIABILITY, ("out", lambda d: "SELECT 1"))).text(Duck()).removeprefix("WITH ").removesuffix(chr(10) + "SELECT 1")},
halved(step, lower, n, k, a, b, c, d) AS (
  SELECT 0, lower, n_fights, n_won, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE FROM reliability
  UNION ALL
  SELECT step + 1, lower, n, k, CASE WHEN {_tail('k', 'n', '((a + b) / 2)')} < 0.025 THEN (a + b) / 2 ELSE a END, CASE WHEN {_tail('k', 'n', '((a + b) / 2)')} < 0.025 THEN b ELSE (a + b) / 2 END,
    CASE WHEN {_tail('0', 'k', '((c + d) / 2)')} < 0.025 THEN c ELSE (c + d) / 2 END, CASE WHEN {_tail('0', 'k', '((c + d) / 2)')} < 0.025 THEN (c + d) / 2 ELSE d END
  FROM halved WHERE step < 50)
SELECT r.*, round(CASE WHEN n_won > 0 THEN (a + b) / 2 ELSE 0 END, 9) AS ci_lower, round(CASE WHEN n_won < n_fights THEN (c + d) / 2 ELSE 1 END, 9) AS ci_upper
FROM reliability r JOIN halved h ON h.lower = r.lower AND h.step = 50"""

_PARTS = ", ".join(f"({i}, '{rung}', '{p}')" for i, (rung, parts) in enumerate(model.RUNGS.items()) for p in parts)
_NAMES = ", ".join(f"('{c}')" for c in (*[f"{c}_{s}" for c in model.SIDED_RATED for s in "ab"], *model.SHARED_RATED))
RUNGS = f"""WITH parts(place, rung, part) AS (VALUES {_PARTS}), names(column_name) AS (VALUES {_NAMES})
SELECT DISTINCT r.rung, n.column_name FROM parts r JOIN parts p ON p.place <= r.place JOIN names n ON contains(n.column_name, p.part)"""

SQL = {"elo": ELO, "glicko2": GLICKO2, "pagerank_ticks": PAGERANK_TICKS, "emit_graph": EMIT_GRAPH, "folds": FOLDS, "clopper_pearson": CLOPPER_PEARSON, "model_rungs": RUNGS}
