"""Registering plans as queries with their printed SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import kept
from ..plans.bouts import FROM_SALES
from ..plans.dialect import Duck, Plan

Query = Callable[[SparkSession, str], DataFrame]
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def planned(plan: Plan, *names: str) -> tuple[Query, str]:
    """A query that runs the plan over the named tables, and its SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan.run(spark, tables(spark, sf_dir, *names))

    return query, plan.text(Duck())


def staged(parts: tuple, *names: str) -> Query:
    """A query whose ``parts`` use bouts several times: they are made once, written
    to the checkpoint folder, and read by every use."""
    rest = Plan((("bouts", lambda d: "SELECT * FROM " + d.table("bouts_kept")), *parts))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = tables(spark, sf_dir, *names)
        bouts = kept(FROM_SALES.then(("out", lambda d: "SELECT * FROM bouts")).run(spark, source))
        return rest.run(spark, {**source, "bouts_kept": bouts})

    return query


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def plan(self, name: str, plan: Plan, *names: str) -> None:
        self.queries[name], self.sql[name] = planned(plan, *names)

    def staged(self, name: str, parts: tuple, *names: str) -> None:
        self.queries[name] = staged(parts, *names)
        self.sql[name] = FROM_SALES.then(*parts).text(Duck())

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql
