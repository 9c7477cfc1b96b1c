"""As-of and bucket joins, which Spark has no operator for.

An as-of join is a union and a window: rows of both sides are dealt and sorted by
key and time once, and each left row takes the last (or next) right row. No range
join, and no more rows than both sides have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """Left rows with ``values`` and ``matched_at`` of the nearest right row of
    the same keys: the last at or before ``time``, or the first at or after it
    if ``forward``; ``strict`` leaves equal times out. NULL where there is none.

    Of right rows with equal keys and time, the greatest values count."""
    right = right.groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v")).select(*keys, time, F.struct(F.col(time).alias("matched_at"), *[F.col(f"_v.{v}").alias(v) for v in values]).alias("_right"))
    kind = right.schema["_right"].dataType
    rows = left.withColumn("_left", F.struct(*left.columns)).select(*keys, time, F.lit(None).cast(kind).alias("_right"), "_left")
    both = rows.unionByName(right.select(*keys, time, "_right", F.lit(None).cast(rows.schema["_left"].dataType).alias("_left")))
    # the right row comes first at equal times, unless equal times don't count
    side = F.when(F.col("_left").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    order: list[Column] = [F.col(time).desc() if forward else F.col(time).asc(), side]
    seen = F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_m", seen).where("_left is not null").select("_left.*", "_m.matched_at", *[F.col(f"_m.{v}").alias(v) for v in values])


def bucket_join(rows: DataFrame, value: str, buckets: DataFrame, lower: str = "lower", upper: str = "upper", to_lower: bool = True) -> DataFrame:
    """Rows with the bucket their value falls in; outside values go to the
    nearest end. On a shared bound the lower bucket counts, or the upper one if
    not ``to_lower``. ``buckets`` is a dimension of a few rows; it is checked to
    be small before it is broadcast."""
    n = buckets.count()
    if n > 10_000:
        raise ValueError("bucket_join is for dimensions; use asof_join on the lower bounds")
    sorted_ = F.array_sort(F.collect_list(F.struct(lower, upper, *[c for c in buckets.columns if c not in (lower, upper)])))
    dim = buckets.agg(sorted_.alias("_all"))
    v = F.col(value)
    fits = F.filter("_all", lambda b: (v <= b[upper]) if to_lower else (v < b[upper]))
    chosen = F.when(F.size(fits) > 0, F.try_element_at(fits, F.lit(1))).otherwise(F.try_element_at("_all", F.lit(-1)))
    return rows.crossJoin(F.broadcast(dim)).withColumn("_b", chosen).drop("_all").select(*rows.columns, *[F.col(f"_b.{c}").alias(c) for c in buckets.columns])
