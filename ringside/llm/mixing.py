"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / size of the source copies. The
documents of a source are laid end to end by size; the prefix sums of expected
copies, moved by one random offset a source, cross whole numbers, and a copy is
emitted at each crossing. Ordering by size makes the words taken follow the
target as closely as the copies do.

The order is found by ranges over (source, size, doc_id), so a source with a
third of all rows is spread over as many ranges as its rows fill; only counts a
range and source are brought together. Expected copies are whole numbers of
2^-24, so prefix sums are exact in any order, and reruns agree. Only DataFrame
functions are used.

Defined results: null text has size 0; a null source is a source of its own,
ordered last; a source of size 0 has target 0; repeated rows are sampled apart;
documents of one size go by doc_id, then by a hash of the text; a very long text
is one document and taken whole; empty input gives an empty result; ``mixed``
keeps all columns and reserves names that begin with ``_rs_``. Prefix sums are
64-bit: a source holds up to 2^38 documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for each source.

    Water-filling: with the sources ordered by cap / weight, the first k stop
    at their cap and the rest share what is left by weight, for the smallest k
    that leaves none above its cap. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        rows.withColumn("left", F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("fits", F.col("level") <= F.col("ratio"))
        .withColumn("at", F.row_number().over(by_ratio))
    )
    level = F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(all_rows)
    return rows.withColumn("level", level["level"]).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def copies(sizes: DataFrame, goal: DataFrame, seed: str = SEED) -> DataFrame:
    """Add source_size, target and n_copies to (doc_id, th, source, size)."""
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("th").asc_nulls_first()]
    dealt = checkpointed(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + F.lit(0.5))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("expected", expected).withColumn("offset", offset)
    # a row for each range and source that meet: about as many as ranges and sources together
    parts = dealt.groupBy("part", "source").agg(F.count("*").alias("n"))
    parts = parts.join(goal, parts["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum(F.col("n") * F.col("expected")).over(earlier), F.lit(0)) + F.col("offset"))
    parts = parts.select(F.col("part").alias("_part"), F.col("source").alias("_source"), "source_size", "target", "expected", "base")
    rows = dealt.join(parts, (dealt["part"] == parts["_part"]) & dealt["source"].eqNullSafe(parts["_source"]))
    upto = Window.partitionBy("part", "source").orderBy("size", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("expected").over(upto) + F.col("base"))
    # shifted, not divided: sums over 2^53 would be rounded as doubles
    crossed = F.shiftright("upto", UNIT_BITS) - F.shiftright(F.col("upto") - F.col("expected"), UNIT_BITS)
    return rows.select("doc_id", "th", "source", "size", "source_size", "target", crossed.cast("long").alias("n_copies"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, th (text hash), source, size, source_size, target, n_copies."""
    sizes = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("source").cast("string").alias("source"),
            size_of(text_or_empty()).alias("size"),
        )
    )
    return copies(sizes, targets(sizes, weights, share, most), seed)


def digests(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "source", "n_copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as its copies say."""
    total = plan(docs, **how).groupBy("doc_id", "th").agg(F.sum("n_copies").alias("_rs_copies"), F.count("*").alias("_rs_same"))
    total = total.where("_rs_copies > 0").select(F.xxhash64("doc_id", "th").alias("_rs_k"), F.col("th").alias("_rs_th"), "_rs_copies", "_rs_same")
    # keys without nulls: rows are dealt once, for the join and for the window
    rows = docs.withColumn("_rs_th", F.xxhash64("text")).withColumn("_rs_k", F.xxhash64(F.col("doc_id").cast("long"), "_rs_th"))
    rows = rows.join(total, ["_rs_k", "_rs_th"])
    # equal rows share the copies of their group evenly
    nth = F.row_number().over(Window.partitionBy("_rs_k", "_rs_th").orderBy("_rs_th"))
    share = F.floor(F.col("_rs_copies") * nth / F.col("_rs_same")) - F.floor(F.col("_rs_copies") * (nth - 1) / F.col("_rs_same"))
    rows = rows.withColumn("_rs_n", share.cast("int")).where("_rs_n > 0")
    return rows.withColumn("_rs_copy", F.explode(F.sequence(F.lit(1), F.col("_rs_n")))).select(*docs.columns)
