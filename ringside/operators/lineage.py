"""Cutting lineage in storage that all machines share."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's ``spark.checkpoint.dir``. A temporary
    one is made only where that is unset and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ringside-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read from there from now on.
    Shuffle files and checkpoints of finished steps go, as Spark drops them only when
    the driver collects its garbage: those of the step before soon after this one began
    (Python's handles are given back within a second), the others at its end."""
    spark = df.sparkSession
    shared_folder(spark)
    collect = spark.sparkContext._jvm.System.gc
    gc.collect()
    soon = threading.Timer(2.0, collect)
    soon.daemon = True
    soon.start()
    try:
        df = df.checkpoint(eager=True)
    finally:
        soon.cancel()
    gc.collect()
    collect()
    return df


def packed(df: DataFrame) -> DataFrame:
    """As ``kept``, for large tables: batches are written as compressed columns, a
    fraction of the rows' size."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("batch"):
                with pa.ipc.open_stream(x.as_buffer()) as rows:
                    yield from rows

    return kept(df.mapInArrow(write, "batch binary")).mapInArrow(read, df.schema)
