"""Data-quality run: python -m ringside.validate TABLES OUT [LABEL_START [TODAY]].

Checks the canonical tables in the folder TABLES, replaces the quarantine table
and writes the report as JSON under OUT; exit code 1 where the label era isn't
clean.
"""

from __future__ import annotations

import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.stores import replace
from .plans import quality as Q
from .plans.dialect import Plan
from .schemas import opened
from .session import session

LABEL_START = "2010-01-01"


def findings(spark: SparkSession, tables: dict[str, DataFrame], today: str) -> DataFrame:
    return Plan((Q.all_findings(today), ("out", lambda d: "SELECT * FROM violations"))).run(spark, {**tables, "contests": tables["events"]})


def run(spark: SparkSession, folder: str, out: str, label_start: str = LABEL_START, today: str | None = None) -> bool:
    """Write quarantine and report; True where the label era is clean."""
    now = datetime.now(UTC).replace(tzinfo=None)
    found = findings(spark, opened(spark, folder), today or now.date().isoformat()).persist()
    held = Plan((("violations", lambda d: "SELECT * FROM " + d.table("v")), Q.QUARANTINE)).run(spark, {"v": found})
    replace(held.withColumn("detected_at", F.lit(now)), f"{out}/validation_quarantine")
    report = Plan((("violations", lambda d: "SELECT * FROM " + d.table("v")), Q.era_report(label_start))).run(spark, {"v": found})
    reasons = found.groupBy("reason_code").count().agg(F.map_from_entries(F.collect_list(F.struct("reason_code", "count"))).alias("counts_by_reason"))
    report = report.crossJoin(reasons).withColumn("ran_at", F.lit(now))
    report.coalesce(1).write.mode("overwrite").json(f"{out}/validation_report")
    passed = report.first()["passed"]
    found.unpersist()
    return bool(passed)


if __name__ == "__main__":
    sys.exit(0 if run(session("validate"), *sys.argv[1:5]) else 1)
