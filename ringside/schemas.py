"""Canonical tables: columns, keys, and how rows are checked on the way in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.stores import recovered

_STATS = (
    "knockdowns int, significant_strikes_landed int, significant_strikes_attempted int, total_strikes_landed int, total_strikes_attempted int, "
    "takedowns_landed int, takedowns_attempted int, submission_attempts int, reversals int, control_time_seconds int, scraped_at timestamp_ntz"
)
_SPLITS = ", ".join(f"{n}_{k} int" for n in ("head", "body", "leg", "distance", "clinch", "ground") for k in ("landed", "attempted"))
_LEVELS = "array<struct<price:double,size:double>>"


@dataclass(frozen=True)
class Table:
    ddl: str
    keys: tuple[str, ...]
    #: Counts that are 0 where a page doesn't tell.
    zeros: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


_COUNTS = tuple(c.split()[0] for c in _STATS.split(", ")[:-2])

#: The tables by name. Fixed names and types.
TABLES: dict[str, Table] = {
    "events": Table("event_url string, name string, date date, location string, scraped_at timestamp_ntz", ("event_url",)),
    "fighters": Table("fighter_url string, name string, height_cm double, weight_kg double, reach_cm double, stance string, date_of_birth date, scraped_at timestamp_ntz", ("fighter_url",)),
    "fights": Table(
        "fight_url string, event_url string, fighter_a_url string, fighter_b_url string, winner_url string, method string, ending_round int, ending_time string, "
        "time_format string, referee string, weight_class string, bout_order int, scraped_at timestamp_ntz", ("fight_url",),
    ),
    "fight_totals": Table(f"fight_url string, fighter_url string, {_STATS}", ("fight_url", "fighter_url"), _COUNTS),
    "round_stats": Table(f"fight_url string, fighter_url string, round int, {_STATS}", ("fight_url", "fighter_url", "round"), _COUNTS),
    "sig_strike_breakdowns": Table(f"fight_url string, fighter_url string, round int, {_SPLITS}, scraped_at timestamp_ntz", ("fight_url", "fighter_url", "round"), tuple(c.split()[0] for c in _SPLITS.split(", "))),
    "order_book_snapshots": Table(
        f"market_id string, token_id string, question string, outcome string, bids {_LEVELS}, asks {_LEVELS}, mid_price double, spread double, captured_at timestamp_ntz, tick_id string, "
        "best_bid double, best_ask double, best_bid_size double, best_ask_size double", ("token_id", "captured_at"),
    ),
    "validation_quarantine": Table("table_name string, row_key string, reason_code string, detail string, event_date string, detected_at timestamp_ntz", ("table_name", "row_key", "reason_code")),
    "market_fight_links": Table("fight_url string, token_id string, match_status string, match_method string, candidate_count int, matched_at timestamp_ntz, reviewed_by string", ("fight_url", "token_id")),
    "report_runs": Table(
        "report_run_id string, as_of_timestamp timestamp_ntz, mlflow_run_id string, data_revision string, feature_version string, config_hash string, bout_count int, flagged_count int, created_at timestamp_ntz",
        ("report_run_id",),
    ),
    "paper_signals": Table(
        "signal_id string, report_run_id string, fight_url string, event_date date, fighter_a_url string, fighter_b_url string, fighter_a_name string, fighter_b_name string, weight_class string, market_id string, token_id string, snapshot_timestamp timestamp_ntz, tick_id string, p_model double, p_market_mid double, best_bid double, best_ask double, best_bid_size double, best_ask_size double, mismatch double, gate_verdict string, bucket_id string, bucket_n int, bucket_calibration_error double, bucket_ci_lower double, bucket_ci_upper double, min_prior_ufc_fights int, sparse_history boolean, match_status string, mlflow_run_id string, data_revision string, feature_version string, config_hash string, created_at timestamp_ntz",
        ("signal_id",),
    ),
    "post_signal_snapshots": Table(
        "snapshot_id string, signal_id string, token_id string, scheduled_offset string, scheduled_at timestamp_ntz, actual_captured_at timestamp_ntz, status string, failure_reason string, best_bid double, best_ask double, best_bid_size double, best_ask_size double, mid_price double, captured_at timestamp_ntz",
        ("snapshot_id",),
    ),
    "due_diligence_verdicts": Table(
        "fight_url string, report_run_id string, verdict string, confidence double, evidence_urls array<string>, summary string, checklist_json string, prompt_version string, model_name string, model_version string, invoked_at timestamp_ntz",
        ("fight_url", "report_run_id"),
    ),
    "due_diligence_runs": Table(
        "run_id string, fight_url string, report_run_id string, prompt_version string, model_name string, model_version string, invoked_at timestamp_ntz, response_latency_ms int, success boolean, error_reason string",
        ("run_id",),
    ),
    "verdict_scoreboard": Table("fight_url string, report_run_id string, verdict string, mismatch_at_signal double, fight_resolved boolean, outcome_correct boolean, resolved_at timestamp_ntz", ("fight_url", "report_run_id")),
}


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The table's columns and types: missing ones NULL (counts 0), others dropped."""
    t = TABLES[name]
    have = set(df.columns)
    cols = []
    for f in t.schema:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, F.lit(0)) if f.name in t.zeros else c).alias(f.name))
    return df.select(*cols)


def checked(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a whole key, rows without)."""
    whole = F.lit(True)
    for k in TABLES[name].keys:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole), df.where(~whole)


def opened(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables under ``root`` (a folder of Parquet tables); one that isn't
    there yet is empty, and one written by an older version gets the new columns."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = {}
    for name, t in TABLES.items():
        recovered(spark, f"{root}/{name}")
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        there = path.getFileSystem(conf).exists(path)
        out[name] = conformed(spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}"), name) if there else spark.createDataFrame([], t.schema)
    return out
