"""Writes against keyed tables, shown on orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stores
from .base import Registry, tables

_r = Registry()


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A table of two thirds of the orders, and a batch with every second order,
    each twice, with a new status and price."""
    o = tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.lit(0).alias("seq"))
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("N").alias("o_orderstatus"), (F.col("cents") + 1).alias("cents"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return o.where("o_orderkey % 3 <> 0"), new.withColumn("cents", F.col("cents") + F.col("seq"))


_SQL = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, 0 AS seq FROM orders), old AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'N' AS o_orderstatus, cents + 1 + s AS cents, s AS seq FROM o, (VALUES (1), (2)) v(s) WHERE o_orderkey % 2 = 0)"""
KEY = ["o_orderkey"]


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.upsert(*_sides(spark, sf_dir), KEY, "seq")


_r.add("store_upsert", upsert, _SQL + " SELECT * FROM new WHERE seq = 2 UNION ALL SELECT * FROM old WHERE o_orderkey % 2 <> 0")


def partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.partial_upsert(*_sides(spark, sf_dir), KEY, "seq", ["o_custkey"])


_r.add("store_partial_upsert", partial, _SQL + """ SELECT n.o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, n.o_orderstatus, n.cents, n.seq FROM new n LEFT JOIN old o ON o.o_orderkey = n.o_orderkey WHERE n.seq = 2
UNION ALL SELECT * FROM old WHERE o_orderkey % 2 <> 0""")


def ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.insert_ignore(*_sides(spark, sf_dir), KEY, "seq")


_r.add("store_insert_ignore", ignore, _SQL + " SELECT * FROM new WHERE seq = 1 AND o_orderkey % 3 = 0")


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return stores.guarded_upsert(old.where("o_orderkey % 2 <> 0"), new, KEY, "seq", F.col("o_orderstatus").isNotNull())


_r.add("store_guarded_upsert", guarded, _SQL + " SELECT * FROM new WHERE seq = 2 UNION ALL SELECT * FROM old WHERE o_orderkey % 2 <> 0")


def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return stores.update_by_key(old, new.where("seq = 2").select("o_orderkey", "o_orderstatus"), KEY)


_r.add("store_update", update, _SQL + " SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, cents, seq FROM old")


def migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _sides(spark, sf_dir)
    return stores.with_columns(old, tick_id="string", best_bid="double", seq="int")


_r.add("store_add_columns", migrate, _SQL + " SELECT *, CAST(NULL AS VARCHAR) AS tick_id, CAST(NULL AS DOUBLE) AS best_bid FROM old")

QUERIES, SQL = _r.queries, _r.sql
