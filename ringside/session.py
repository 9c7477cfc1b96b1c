"""Sessions with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go when nothing refers to them
}


def session(app: str = "ringside", **more: str) -> SparkSession:
    """A session; on a cluster spark-submit gives master, memory and spark.checkpoint.dir."""
    return SparkSession.builder.appName(app).config(map={**SETTINGS, **more}).getOrCreate()
