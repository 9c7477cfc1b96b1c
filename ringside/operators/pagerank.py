"""Prestige: weighted PageRank on the graph of losers and winners, as of any
number of ticks at once.

Edges are aggregated once. All graphs are computed together, keyed by (as_of,
node): each iteration is one join and one aggregation over the edges, dealt by
(as_of, source), with the dangling mass and the change summed a graph, and
checkpointed, so the lineage stays short. A graph has converged when its total
change is below n * tol; its scores stay as they are while others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import kept, packed

# Fixed values.
DAMPING, TOLERANCE, MOST_ITERATIONS = 0.85, 1e-6, 100
FINISH_BONUS = {"KO/TKO": 0.3, "Submission": 0.2}
EARLY_BONUS, DECAY, DAYS_A_YEAR = 0.1, 0.3, 365.25


def graphs(bouts: DataFrame, as_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (as_of, node) and edges (as_of, src, dst, w) of the bouts before
    each tick of ``as_of`` (a small table with one column ``as_of``)."""
    earlier = bouts.join(F.broadcast(as_of), bouts["tick"] < as_of["as_of"])
    nodes = earlier.select("as_of", F.explode(F.array("a", "b")).alias("node")).distinct()
    won = earlier.where("winner is not null")
    ref = won.groupBy("as_of").agg(F.max("day").alias("ref"))
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in FINISH_BONUS.items() for x in kv])[F.col("method")], F.lit(0.0))
    early = F.when(F.col("ending_round") <= 2, EARLY_BONUS).otherwise(0.0)
    weight = (1.0 + bonus + early) * F.exp(-DECAY * (F.col("ref") - F.col("day")) / DAYS_A_YEAR)
    loser = F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    edges = won.join(F.broadcast(ref), "as_of").groupBy("as_of", loser.alias("src"), F.col("winner").alias("dst")).agg(F.sum(weight).alias("w"))
    return nodes, edges


def ranked(nodes: DataFrame, edges: DataFrame, alpha: float = DAMPING, tol: float = TOLERANCE, most: int = MOST_ITERATIONS) -> DataFrame:
    """as_of, node, score. Nodes without any edge get their graph's least score."""
    nodes, edges = kept(nodes), packed(edges)
    total = edges.groupBy("as_of", F.col("src").alias("node")).agg(F.sum("w").alias("out"))
    share = packed(edges.join(total.withColumnRenamed("node", "src"), ["as_of", "src"]).select("as_of", "src", "dst", (F.col("w") / F.col("out")).alias("p")))
    size = nodes.groupBy("as_of").agg(F.count("*").alias("n"))
    state = kept(
        nodes.join(size, "as_of").join(total, ["as_of", "node"], "left")
        .select("as_of", "node", "n", F.col("out").isNull().alias("dangling"), (1.0 / F.col("n")).alias("x"), F.lit(None).cast("double").alias("moved"))
    )
    for _ in range(most):
        lost = state.groupBy("as_of").agg(
            F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(0.0)).alias("lost"), F.coalesce(F.sum("moved") >= F.first("n") * tol, F.lit(True)).alias("live")
        )
        flow = share.join(state.select("as_of", F.col("node").alias("src"), "x"), ["as_of", "src"]).groupBy("as_of", F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("f"))
        new = alpha * (F.coalesce("f", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - alpha) / F.col("n")
        state = kept(
            state.join(flow, ["as_of", "node"], "left").join(lost, "as_of").withColumn("new", F.when(F.col("live"), new).otherwise(F.col("x")))
            .select("as_of", "node", "n", "dangling", F.col("new").alias("x"), F.abs(F.col("new") - F.col("x")).alias("moved"))
        )
        off = state.groupBy("as_of").agg((F.sum("moved") >= F.first("n") * tol).alias("off")).agg(F.max("off")).first()[0]
        if not off:
            break
    linked = edges.select("as_of", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("linked", F.lit(True))
    least = state.groupBy("as_of").agg(F.min("x").alias("least"))
    return state.join(linked, ["as_of", "node"], "left").join(least, "as_of").select("as_of", "node", F.when(F.col("linked"), F.col("x")).otherwise(F.col("least")).alias("score"))
