"""Shared helpers: table reading, checkpoints, stable row keys, global order."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROWS_A_FILE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all machines share.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset and
    all tasks run on this machine (tests) a temporary one is made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ringside-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut lineage with a checkpoint in shared storage.

    ``rows``: about how many rows are expected; so few files are written for
    small tables, and as many as needed for large ones.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def settled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """As ``checkpointed``, and the shuffle files of finished steps go. Spark drops
    them only when the driver collects its garbage, which may not happen before
    many steps have left theirs. Python's handles are given back within a second,
    so a step's files go at the next call at the latest, unless its plan is still
    in a variable."""
    spark = df.sparkSession
    df = checkpointed(df, rows)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return df


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Return freed memory to the machine: workers outlive their tasks, and what
    they keep is missing elsewhere on the executor."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


BLOCK = 64


def in_blocks(items: Column, size: int = BLOCK) -> Column:
    """An array cut into arrays of ``size`` items (none for an empty one)."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i * size + 1, size))


def placed(items: Column, width: Callable[[Column], Column]) -> Column:
    """Each item with ``at``, the sum of the widths before it: array of struct
    (at, item). Sums are taken in blocks and over blocks, so a long array isn't
    copied for each of its items."""

    def of_block(block: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.slice(F.transform(block, lambda x: F.struct(start.alias("at"), x.alias("item"))), 1, 0).alias("out"))
        step = lambda acc, x: F.struct(
            (acc["at"] + width(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("item")))).alias("out")
        )
        return F.aggregate(block, none, step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + width(x)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, of_block))

    return bound(items, lambda it: bound(in_blocks(it), of_blocks))


def global_next(df: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """Add ``next``: a struct of ``carry`` from the row that follows in the
    global order; the row after the last is the first (a single row follows
    itself).

    The order is found by ranges, never in one task: rows are dealt by range,
    each range is ordered by itself, and only the first row of each range
    (as many rows as partitions) is passed on to the range before it. The dealt
    rows are checkpointed, so that a lost executor can't redraw the ranges.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    what = F.struct(*carry)
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(*order, *[c for c in carry if c not in order])).alias("_first"))
    # one row for each partition from here on: a single small window is bounded
    w = Window.orderBy("_part")
    all_rows = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select(
        "_part",
        F.coalesce(F.lead("_first").over(w), F.first("_first").over(all_rows)).alias("_head"),
    ).select("_part", F.struct(*[F.col(f"_head.{c}").alias(c) for c in carry]).alias("_head"))
    in_part = Window.partitionBy("_part").orderBy(*order)
    return (
        dealt.withColumn("_lead", F.lead(what).over(in_part))
        .join(F.broadcast(heads), "_part")
        .withColumn("next", F.coalesce("_lead", "_head"))
        .drop("_lead", "_head", "_part")
    )
