"""Ratings, prestige, common opponents and the graph family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import card, dealt, pagerank, ratings, shared
from ..operators.lineage import kept, packed
from ..plans import features as feats
from ..plans import opponents
from ..plans.bouts import FIGHTERS_FROM_SALES, FROM_SALES
from ..plans.dialect import Duck, Plan
from ..plans.replay import RECORD_ONLY, REPLAY, replay
from . import apart
from .base import Registry, tables

_r = Registry()
SALES = ("lineitem", "orders", "customer")


def _bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _BOUTS.run(spark, tables(spark, sf_dir, *SALES))


_BOUTS = FROM_SALES.then(("out", lambda d: "SELECT fight_url, tick, day, a, b, winner, method, ending_round, event_date FROM bouts"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ratings.elo_of(ratings.rated(_bouts(spark, sf_dir), ("elo",))))


def glicko2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ratings.glicko_of(ratings.rated(_bouts(spark, sf_dir), ("glicko2",))))


def _asked(bouts: DataFrame, every: int) -> DataFrame:
    """The first tick of each ``every`` days, and the one after the last."""
    asked = bouts.groupBy(F.floor(F.col("day") / every).alias("span")).agg(F.min("tick").alias("as_of"))
    return asked.select("as_of").union(bouts.select((F.max("tick") + 1).alias("as_of")))


def pagerank_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prestige at the start of each year and after the last event."""
    bouts = _bouts(spark, sf_dir)
    return _rounded(pagerank.ranked(*pagerank.graphs(bouts, _asked(bouts, 365))))


def pagerank_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prestige after the last event, by 20 fixed iterations (for the SQL twin)."""
    bouts = _bouts(spark, sf_dir)
    nodes, edges = pagerank.graphs(bouts, bouts.select((F.max("tick") + 1).alias("as_of")))
    return _rounded(pagerank.ranked(nodes, edges, tol=0.0, most=20))


_PAGERANK_SQL = (
    "WITH RECURSIVE "
    + _BOUTS.text(Duck())[5:].rsplit("SELECT fight_url, tick, day, a, b", 1)[0].rstrip()
    + """,
nodes AS (SELECT DISTINCT unnest([a, b]) AS node FROM bouts),
latest AS (SELECT max(day) AS ref FROM bouts WHERE winner IS NOT NULL),
edges AS (SELECT CASE WHEN winner = a THEN b ELSE a END AS src, winner AS dst,
  sum((1.0::DOUBLE + CASE method WHEN 'KO/TKO' THEN 0.3 WHEN 'Submission' THEN 0.2 ELSE 0 END + CASE WHEN ending_round <= 2 THEN 0.1 ELSE 0 END) * exp(-0.3::DOUBLE * (ref - day) / 365.25::DOUBLE)) AS w
  FROM bouts, latest WHERE winner IS NOT NULL GROUP BY 1, 2),
outs AS (SELECT src AS node, sum(w) AS tot FROM edges GROUP BY 1),
share AS (SELECT e.src, e.dst, e.w / o.tot AS p FROM edges e JOIN outs o ON o.node = e.src),
size AS (SELECT count(*)::DOUBLE AS n FROM nodes),
pr(k, node, x) AS (
  SELECT 0, node, 1 / n FROM nodes, size
  UNION ALL
  SELECT s.k + 1, s.node, 0.85::DOUBLE * (coalesce(f.f, 0) + s.lost / n) + 0.15::DOUBLE / n
  FROM (SELECT p.k, p.node, p.x, sum(CASE WHEN o.node IS NULL THEN p.x ELSE 0 END) OVER () AS lost FROM pr p LEFT JOIN outs o ON o.node = p.node WHERE p.k < 20) s
  LEFT JOIN (SELECT sh.dst AS node, sum(p.x * sh.p) AS f FROM pr p JOIN share sh ON sh.src = p.node GROUP BY 1) f ON f.node = s.node, size)
SELECT (SELECT max(tick) + 1 FROM bouts)::INT AS as_of, node,
  round(CASE WHEN node IN (SELECT src FROM edges UNION SELECT dst FROM edges) THEN x ELSE min(x) OVER () END, 6) AS score
FROM pr WHERE k = 20"""
)

_COMMON = (*RECORD_ONLY, opponents.NO_QUALITY, *opponents.COMMON[:-1], ("out", opponents.COMMON[-1][1]))


def _groups(spark: SparkSession, sf_dir: str) -> tuple[list[str], int]:
    """(bounds that cut contestants into groups, number of bouts at most)"""
    source = tables(spark, sf_dir, "lineitem", "orders")
    n = source["orders"].count()
    cuts = shared.bounds_of(source["lineitem"].select("l_suppkey"), "l_suppkey", 2 * n)
    return [f"c{k:09}" for k in cuts], n


def common_opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounded(shared.finished(shared.sums(_bouts(spark, sf_dir), *_groups(spark, sf_dir))))
    delta = F.col("common_opp_score_delta")
    return rows.withColumn("common_opp_score_delta", F.when(delta == 0, F.lit(0.0)).otherwise(delta))  # no negative zero


_r.add("common_opponents", common_opponents, FROM_SALES.then(*_COMMON).text(Duck()))
_r.add("elo", elo, apart.SQL["elo"])
_r.add("glicko2", glicko2, apart.SQL["glicko2"])
_r.add("pagerank_ticks", pagerank_ticks, apart.SQL["pagerank_ticks"])
_r.add("pagerank_asof", pagerank_asof, _PAGERANK_SQL)


def graph_family(bouts: DataFrame, bounds: list[str], expected: int) -> DataFrame:
    """The 13 columns of the graph family, for both sides of every bout: ratings
    before the tick, prestige at the start of the span the bout is in, and common
    opponents, weighed by those of theirs, seen from the side."""
    both = packed(ratings.rated(bouts, after_all=True))
    asked = _asked(bouts, 365)
    prestige = pagerank.ranked(*pagerank.graphs(bouts, asked)).select("as_of", F.col("node").alias("fighter"), F.col("score").alias("pagerank_score"))
    prestige = packed(prestige)
    known = both.where("system = 'elo' and v0 is not null").select("fighter", "tick", F.col("v0").alias("elo"))
    common = shared.finished(shared.sums(bouts, bounds, expected, known, prestige.select("fighter", F.col("as_of").alias("tick"), F.col("pagerank_score").alias("score"))))
    spans = bouts.groupBy(F.floor(F.col("day") / 365).alias("span")).agg(F.min("tick").alias("as_of"))
    rows = bouts.select("fight_url", F.floor(F.col("day") / 365).alias("span"), F.posexplode(F.array("a", "b")).alias("side", "fighter")).join(F.broadcast(spans), "span")
    rows = rows.join(ratings.elo_of(both), ["fight_url", "fighter"], "left").join(ratings.glicko_of(both), ["fight_url", "fighter"], "left")
    rows = rows.join(prestige, ["as_of", "fighter"], "left").join(common, "fight_url")
    swap = lambda x, y: F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y))
    return rows.select(
        "fight_url", F.col("side").cast("int").alias("side"), "elo_rating", "elo_peak", "elo_current_vs_peak", "elo_trajectory_last5", "glicko2_rating", "glicko2_rd", "pagerank_score", "n_common_opponents",
        swap("common_opp_score_a", "common_opp_score_b").alias("common_opp_score_a"), swap("common_opp_score_b", "common_opp_score_a").alias("common_opp_score_b"),
        F.when(F.col("side") == 0, F.col("common_opp_score_delta")).otherwise(-F.col("common_opp_score_delta")).alias("common_opp_score_delta"),
        swap("common_opp_a_win_rate", "common_opp_b_win_rate").alias("common_opp_a_win_rate"), swap("common_opp_b_win_rate", "common_opp_a_win_rate").alias("common_opp_b_win_rate"),
    )


def emit_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph_family(packed(_bouts(spark, sf_dir)), *_groups(spark, sf_dir)))


def _kept_bouts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The source tables, and the bouts as ``bouts_kept``."""
    source = tables(spark, sf_dir, *SALES, "supplier")
    source["bouts_kept"] = packed(FROM_SALES.then(("out", lambda d: "SELECT * FROM bouts")).run(spark, source))
    return source


_GIVEN = Plan((("bouts", lambda d: "SELECT * FROM " + d.table("bouts_kept")),))


def _side_rows(spark: SparkSession, source: dict[str, DataFrame], fields: tuple[str, ...]) -> DataFrame:
    """These fields of each side, as ``feats.side_part`` names them."""
    carried = {f.split(".")[1] for f in fields if "." in f}
    return _GIVEN.then(FIGHTERS_FROM_SALES, *replay(carried), feats.side_part(fields)).run(spark, source)


def _rating_rows(both: DataFrame, system: str, **values: str) -> DataFrame:
    return both.where((F.col("system") == system) & (F.col("side") >= 0)).select("fight_url", "side", *[F.col(v).alias(c) for c, v in values.items()])


def _prestige(bouts: DataFrame) -> DataFrame:
    return packed(pagerank.ranked(*pagerank.graphs(bouts, _asked(bouts, 365))).select("as_of", F.col("node").alias("fighter"), F.col("score").alias("pagerank_score")))


def _prestige_rows(bouts: DataFrame, prestige: DataFrame) -> DataFrame:
    """Prestige of both sides at the start of the span that the bout is in."""
    span = F.floor(F.col("day") / 365).alias("span")
    spans = kept(bouts.groupBy(span).agg(F.min("tick").alias("as_of")))
    rows = bouts.select("fight_url", span, F.posexplode(F.array("a", "b")).alias("side", "fighter")).join(F.broadcast(spans), "span")
    return packed(rows.join(prestige, ["as_of", "fighter"], "left").select("fight_url", "side", "pagerank_score"))


def rated_pairs(spark: SparkSession, sf_dir: str, sided: tuple[str, ...], shared_columns: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """fight_url, result (of the first side), ``more`` fields, the sided features as
    ``_a`` and ``_b``, and the first side's shared ones: a row a bout, in which only
    what these features read is made."""
    made = feats.formulas((*sided, *shared_columns))
    fields = feats.read_by([*made.values(), *more])
    source = _kept_bouts(spark, sf_dir)
    bouts = source["bouts_kept"]
    both = packed(ratings.rated(bouts).select("system", "fight_url", "side", "v0"))
    prestige = _prestige_rows(bouts, _prestige(bouts))
    frames = [_side_rows(spark, source, fields), _rating_rows(both, "elo", elo_rating="v0"), _rating_rows(both, "glicko2", glicko2_rating="v0"), prestige]
    rows = dealt.side_by_side(frames, source["orders"].count(), both=False)
    rated = {c: [f"{p}{c}" for p in ("x_", "y_")] for c in ("elo_rating", "glicko2_rating", "pagerank_score")}
    deltas = {"elo_delta": "x_elo_rating - y_elo_rating", "pagerank_delta": "x_pagerank_score - y_pagerank_score"}
    given, out = rows.columns, ["fight_url", "x_result AS result", *[f"x_{c} AS {c}" for c in more]]
    for i, (s, own, other) in enumerate((("a", "x_", "y_"), ("b", "y_", "x_"))):
        framed = rows.selectExpr(*rows.columns, *feats.framed_from(fields, own, other))
        names = {c: f"{made[c]} AS {c}_{s}" for c in sided if c in made}
        pair = [f"{made[c] if c in made else deltas[c]} AS {c}" for c in shared_columns] if i == 0 else []
        rows = framed.selectExpr(*given, *names.values(), *pair)
        given = rows.columns
    shown = [f"{c}_{s}" if c in made else f"{rated[c][i]} AS {c}_{s}" for c in sided for i, s in enumerate("ab")]
    return rows.selectExpr(*out, *shown, *shared_columns)


def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 123 columns of the twelve families, a row for each side of each bout. The
    replay's come from its plan, the graph family's from the operators, and the two
    rating differences from both sides of the latter."""
    made = feats.formulas()
    head = ("event_url", "event_date", "fighter", "opponent")
    fields = feats.read_by([*made.values(), *head])
    source = _kept_bouts(spark, sf_dir)
    bouts = source["bouts_kept"]
    both = packed(ratings.rated(bouts, after_all=True))
    prestige = _prestige(bouts)
    known = both.where("system = 'elo' and v0 is not null").select("fighter", "tick", F.col("v0").alias("elo"))
    common = packed(shared.finished(shared.sums(bouts, *_groups(spark, sf_dir), known, prestige.select("fighter", F.col("as_of").alias("tick"), F.col("pagerank_score").alias("score")))))
    prestige = _prestige_rows(bouts, prestige)
    limits = kept(_GIVEN.then(FIGHTERS_FROM_SALES, REPLAY[0], *feats.LIMITS).run(spark, source))
    carded = card.averages(_GIVEN.then(REPLAY[0], card.LISTED).run(spark, source)).selectExpr("fight_url", "side", *feats.shown_card(None))
    elo = _rating_rows(both, "elo", elo_rating="v0", elo_peak="v1", elo_trajectory_last5="v2")
    frames = [_side_rows(spark, source, fields), carded, elo, _rating_rows(both, "glicko2", glicko2_rating="v0", glicko2_rd="v1"), prestige, common]
    rows = dealt.side_by_side(frames, source["orders"].count(), both=True)
    rows = rows.selectExpr("side", *[c for c in rows.columns if c != "side"], *feats.framed_from(fields, "x_", "y_"))
    near = limits.select(F.col("yr").alias("_yr"), F.col("weight_class").alias("_class"), "reach_p75", "height_p75")
    rows = rows.join(F.broadcast(near), (F.col("_class") == F.col("last_state.klass")) & (F.col("_yr") == F.year("event_date")), "left")  # classes by years
    seen = lambda x, y: f"CASE WHEN side = 0 THEN {x} ELSE {y} END"
    cards = [f"x_{c} AS {c}" for c in feats.CARD_COLUMNS]
    graph = [
        "x_elo_rating AS elo_rating", "x_elo_peak AS elo_peak", "try_divide(x_elo_rating, x_elo_peak) AS elo_current_vs_peak", "x_elo_trajectory_last5 AS elo_trajectory_last5",
        "x_glicko2_rating AS glicko2_rating", "x_glicko2_rd AS glicko2_rd", "x_pagerank_score AS pagerank_score", "n_common_opponents",
        f"{seen('common_opp_score_a', 'common_opp_score_b')} AS common_opp_score_a", f"{seen('common_opp_score_b', 'common_opp_score_a')} AS common_opp_score_b",
        f"{seen('common_opp_score_delta', '-common_opp_score_delta')} AS common_opp_score_delta",
        f"{seen('common_opp_a_win_rate', 'common_opp_b_win_rate')} AS common_opp_a_win_rate", f"{seen('common_opp_b_win_rate', 'common_opp_a_win_rate')} AS common_opp_b_win_rate",
        "x_elo_rating - y_elo_rating AS elo_delta", "x_pagerank_score - y_pagerank_score AS pagerank_delta",
    ]
    first = ["fight_url", "side", "event_url", "CAST(event_date AS VARCHAR(10)) AS event_date", "fighter", "opponent"]
    return _rounded(rows.selectExpr(*first, *[f"{c} AS {n}" for n, c in made.items()], *cards, *graph))


_r.add("features_all", features_all)
_r.add("emit_graph", emit_graph, apart.SQL["emit_graph"])

QUERIES, SQL = _r.queries, _r.sql
