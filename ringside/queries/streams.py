"""Streams over the events table, each checked against its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..streaming import capture as S
from .base import Registry

_r = Registry()


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines share, for checkpoints and results."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, build, mode: str = "complete") -> DataFrame:
    at = _folder(spark)
    return S.run_to_table(build(S.event_stream(spark, sf_dir)), f"{at}/out", f"{at}/checkpoint", mode)


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    S.capture(S.quotes(S.event_stream(spark, sf_dir)), at, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/good").select("token_id", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"), "mid")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, lambda s: S.windowed(s, "1 hour"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, lambda s: S.windowed(s, "1 hour", "30 minutes"))


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, S.sessions)


def stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, S.running_records, "update")


_WINDOW = "count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events"
_r.add("stream_capture", capture, "SELECT CAST(user_id AS VARCHAR) AS token_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS captured_at, min(100 + CAST(floor(value * 19.6::DOUBLE) AS BIGINT)) AS mid FROM events GROUP BY user_id, ts")
_r.add("stream_tumbling", tumbling, f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, {_WINDOW} GROUP BY 1, 2")
_r.add("stream_sliding", sliding, f"SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, event_type, {_WINDOW}, (VALUES (0), (1)) v(o) GROUP BY 1, 2")
_r.add("stream_session", session, """WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, g""")
_r.add("stream_stateful", stateful, """WITH e AS (SELECT user_id, CAST(floor(value * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS total, CAST(count(*) - coalesce(max(CASE WHEN c < 25000 THEN i END), 0) AS BIGINT) AS streak FROM e GROUP BY user_id""")

QUERIES, SQL = _r.queries, _r.sql
