"""Writes against keyed tables, as whole-table relations.

Without a catalog for row-level changes a write makes the new table from the old
one and a batch, and ``replace`` swaps it in. Keys compare NULL-safe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class LinkOverwriteError(ValueError):
    """A settled row would have been overwritten."""


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def _latest(df: DataFrame, keys: list[str], order: list[Column], first: bool = False) -> DataFrame:
    """One row a key: the last (or first) by ``order``."""
    by = order if first else [F.desc(c) if isinstance(c, str) else c.desc_nulls_last() for c in order]
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Every column of a key from its latest row; the batch wins over the table,
    and within the batch the greatest ``order``. One shuffle by key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return _latest(both, keys, [F.col("_new"), F.col(order)]).drop("_new")


def partial_upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    """Like ``upsert``, but the columns ``keep`` stay as first written."""
    batch = _latest(new, keys, [F.col(order)])
    o, n = old.alias("o"), batch.alias("n")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    joined = o.withColumn("_o", F.lit(True)).alias("o").join(n.withColumn("_n", F.lit(True)).alias("n"), cond, "full_outer")
    has_old, has_new = F.col("o._o").isNotNull(), F.col("n._n").isNotNull()
    pick = lambda c: F.when(has_new & ~(has_old & F.lit(c in keep or c in keys)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(*[pick(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows to append: the first of each new key that the table doesn't have."""
    batch = _latest(new, keys, [F.col(order)], first=True)
    return batch.join(old.select(*keys).alias("_old"), _same(batch, old, keys), "left_anti")


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, settled: Column) -> DataFrame:
    """``upsert`` that refuses to touch rows for which ``settled`` holds."""
    hit = old.where(settled).select(*keys).join(new.select(*keys), _same(old, new, keys), "left_semi").limit(1)
    if not hit.isEmpty():
        raise LinkOverwriteError("a settled row would be overwritten")
    return upsert(old, new, keys, order)


def update_by_key(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``changes`` replace those of the rows with its keys (not null values)."""
    values = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_v_{v}") for v in values])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = old.join(renamed, cond, "left")
    return out.select(*[F.coalesce(F.col(f"_v_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])


def with_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """ADD COLUMN IF NOT EXISTS for each name and type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def recovered(spark: SparkSession, path: str) -> None:
    """Put back the old version where a replace ended between its two renames."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p, o = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.old"))
    fs = p.getFileSystem(conf)
    if not fs.exists(p) and fs.exists(o):
        fs.rename(o, p)


def replace(df: DataFrame, path: str) -> None:
    """Full replace: the new version is written beside the old and the old is
    dropped only when that has ended. A run that ended in between is put right
    by the next one, or by ``recovered``, which readers call."""
    spark = df.sparkSession
    recovered(spark, path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    p, n, o = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, new, old))
    fs.delete(o, True)
    if fs.exists(p):
        fs.rename(p, o)
    fs.rename(n, p)
    fs.delete(o, True)


def pending_calls(
    pending: DataFrame, done: DataFrame, keys: list[str], call: Callable[[dict], dict], schema: str
) -> DataFrame:
    """Calls an outside service once for each key that isn't done: rows of
    ``schema`` with status success or failed and the reason. Idempotent: a key
    in ``done`` is never called again."""
    todo = pending.join(done.select(*keys), _same(pending, done, keys), "left_anti")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({**{k: row[k] for k in keys}, "status": "success", "reason": None, **call(row)})
                except Exception as e:  # the service's own failures are results here
                    out.append({**{k: row[k] for k in keys}, "status": "failed", "reason": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out)

    return todo.mapInPandas(run, schema)
