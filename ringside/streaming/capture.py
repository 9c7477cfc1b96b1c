"""Order-book capture and windows as Structured Streaming.

A capture tick is a micro-batch: snapshots are validated, tagged with an id made
from the batch number, and appended once by (token_id, captured_at); bad rows go
to a side output and are counted, never failing the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
KEYS = ["token_id", "captured_at"]


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).parquet(folder)


def quotes(events: DataFrame) -> DataFrame:
    """Events as quotes of a token: mid in whole ten-thousandths of 1."""
    return events.select(F.col("user_id").cast("string").alias("token_id"), F.col("ts").alias("captured_at"), (100 + F.floor(F.col("value") * 19.6)).cast("long").alias("mid"))


#: How often quotes are captured. Fixed value.
EVERY = "5 minutes"


def capture(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append each new (token_id, captured_at) once; idempotent when a batch is
    run again. Rows without a token or time go to ``out``/bad.

    ``every``: the time between batches (``EVERY`` in production); without it
    what is there now is taken and the query ends. ``capture_counts`` has how
    many rows of each batch were kept and bad."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tagged = batch.withColumn("tick_id", F.sha2(F.lit(str(batch_id)), 256)).persist()
        bad = F.col("token_id").isNull() | F.col("captured_at").isNull()
        tagged.where(bad).write.mode("overwrite").parquet(f"{out}/bad/batch={batch_id}")
        fresh = tagged.where(~bad).withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("mid"))).where("_n = 1").drop("_n")
        conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(f"{out}/good")
        fs = path.getFileSystem(conf)
        span = fresh.agg(F.min("captured_at"), F.max("captured_at")).first()
        if span[0] is not None and fs.exists(path):
            # only what was captured in the batch's span can be there already
            old = spark.read.parquet(f"{out}/good").where((F.col("batch") != batch_id) & F.col("captured_at").between(*span))
            fresh = fresh.join(old.select(*KEYS), KEYS, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/good/batch={batch_id}")
        tagged.unpersist()

    pace = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**pace).start()


def capture_counts(spark: SparkSession, out: str) -> DataFrame:
    """batch, good, bad: the rows of each batch that were kept, and that had no
    token or time."""
    of = lambda kind, flag: spark.read.parquet(f"{out}/{kind}").select("batch", F.lit(flag).alias("good"))
    both = of("good", True).unionByName(of("bad", False))
    return both.groupBy("batch").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


def windowed(stream: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type, tumbling or sliding."""
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "cents"
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no gap of ``gap`` or more."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run over what is there now; the last version of the result as a table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


STATE = "n long, total long, streak long"


def running_records(stream: DataFrame) -> DataFrame:
    """A record for each user kept in state: events, total, and the streak of
    rises of the value (in hundredths) in order of time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, streak = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["cents"]:
            streak = streak + 1 if v >= 25_000 else 0
            n, total = n + 1, total + int(v)
        state.update((n, total, streak))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "streak": [streak]})

    rows = stream.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.floor(F.col("value") * 100).cast("long").alias("cents"))
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total long, streak long", STATE, "update", "NoTimeout")
