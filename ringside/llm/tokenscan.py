"""Token counts of flat token files by separator scan.

A flat token file is nothing but identifiers, document after document, each
ended by one separator identifier; there is no index. Files are read as ranges of
bytes (path, block, offset, size) that cut documents anywhere; a range is read by
itself, so a file of any length is spread over tasks. Each block is searched for
the separator with vector comparisons, and is reduced to the lengths between its
separators, the tokens before the first and those after the last. A prefix scan
over the blocks of a file then numbers the documents and carries each open end
into the next block's first separator.

The scan runs in two levels: within runs of ``RUN`` blocks, and over the runs'
summaries; so a file with a third of all blocks isn't gathered in one task.

Files are listed by Spark, and read and written through pyarrow's file systems
(local and shared folders, HDFS, S3, GCS). A writing task makes a file of its
own; the rows it returns name it, so files of failed tasks are never read.

Defined results: tokens after a file's last separator are one more document
(``open`` is true) if there are any; an empty document has count 0; null content
counts as empty; a block whose bytes aren't whole identifiers raises, and so does
writing an id that is the separator or too large for the width. Repeated rows of
ids are repeated documents; equal lengths are no ties, as documents are numbered
by place; a very long document runs over as many blocks as it fills; an empty
table or folder gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder

RUN = 4096
WIDTHS = {2: "<u2", 4: "<u4"}


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def file_ranges(spark: SparkSession, path: str, block_bytes: int = 1 << 20, range_bytes: int = 32 << 20) -> DataFrame:
    """(path, block, offset, size) of the token files under ``path``; a task gets
    about ``range_bytes`` of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.sum("length")).first()[0] or 0
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
    rows = files.select("path", "length", F.explode(blocks).alias("block")).withColumn("offset", F.col("block") * block_bytes)
    rows = rows.select("path", "block", "offset", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")).alias("size"))
    return rows.repartition(max(1, -(-total // range_bytes)), "path", F.floor(F.col("block") / 8))


def written_files(ids: DataFrame, folder: str, separator: int, width: int = 2, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Write packed 32-bit ids of rows end to end, each ended by ``separator``,
    to one flat file for each partition that has rows; (file, name, doc_index,
    doc_id) of each row. ``file`` is the partition's number."""
    kind = WIDTHS[width]
    if separator >> 8 * width:
        raise ValueError(f"the separator {separator} needs more than {width} bytes")
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        file, out, n = task.partitionId(), None, 0
        name = f"part-{file:05d}-{task.taskAttemptId()}.tokens"  # each attempt has its own
        end = np.array([separator], dtype=kind).tobytes()
        try:
            for b in batches:
                if out is None and b.num_rows:
                    store, place = fs.FileSystem.from_uri(folder)
                    store.create_dir(place, recursive=True)
                    out = store.open_output_stream(f"{place}/{name}", buffer_size=1 << 20)
                for x in b.column(ids_col):
                    row = np.frombuffer(x.as_py() or b"", dtype="<u4")
                    if len(row) and (int(row.max()) >> 8 * width or (row == separator).any()):
                        raise ValueError(f"an id is {separator}, the separator, or needs more than {width} bytes")
                    out.write(row.astype(kind).tobytes() + end)
                at = pa.array(np.arange(n, n + b.num_rows), pa.int64())
                n += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([file] * b.num_rows, pa.int32()), pa.array([name] * b.num_rows, pa.string()), at, b.column(id_col)], names=["file", "name", "doc_index", "doc_id"])
        finally:
            if out is not None:
                out.close()

    rows = ids.select(F.col(id_col).cast("long").alias(id_col), ids_col)
    return checkpointed(rows.mapInArrow(run, "file int, name string, doc_index long, doc_id long"))


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def counted(ids: DataFrame, separator: int, width: int = 2, block_bytes: int = 1 << 20) -> DataFrame:
    """Flat files of all rows of (doc_id, ids), then their counts by separator
    scan: doc_id, n_tokens, file, doc_index. The files are in the shared folder
    while they are needed."""
    spark = ids.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    places = written_files(ids, folder, separator, width)
    if places.isEmpty():
        return places.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "doc_index")
    blocks = file_ranges(spark, folder, block_bytes).withColumn("name", F.substring_index("path", "/", -1))
    blocks = blocks.join(places.select("name").distinct(), "name", "left_semi")  # not those of failed attempts
    counts = token_counts(blocks, separator, width).select(F.substring_index("path", "/", -1).alias("name"), "doc_index", "n_tokens")
    removed(spark, folder)  # the scan's summaries are written out
    return places.join(counts, ["name", "doc_index"]).select("doc_id", "n_tokens", "file", "doc_index")


def summaries(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """path, block, tokens, separators, head (tokens before the first separator),
    tail (after the last; all, if there is none), inner (lengths in between).

    ``blocks`` has path, block and either content or offset and size."""
    kind = WIDTHS[width]
    given = "content" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened: dict[str, pa.NativeFile] = {}

        def read(path: str, offset: int, size: int) -> bytes:
            if path not in opened:
                while opened:
                    opened.popitem()[1].close()
                store, place = fs.FileSystem.from_uri(_uri(path))
                opened[path] = store.open_input_file(place)
            return opened[path].read_at(size, offset)

        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("tokens", "separators", "head", "tail", "inner")}
            for row in zip(*(b.column(c).to_pylist() for c in source), strict=True):
                ids = np.frombuffer((row[0] or b"") if given else read(*row), dtype=kind)
                at = np.flatnonzero(ids == separator)
                cols["tokens"].append(len(ids))
                cols["separators"].append(len(at))
                cols["head"].append(int(at[0]) if len(at) else 0)
                cols["tail"].append(int(len(ids) - at[-1] - 1) if len(at) else len(ids))
                cols["inner"].append((np.diff(at) - 1).tolist())
            arrays = [b.column("path"), b.column("block")]
            arrays += [pa.array(cols[k], pa.int64()) for k in ("tokens", "separators", "head", "tail")] + [pa.array(cols["inner"], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "block", "tokens", "separators", "head", "tail", "inner"])

    source = ["content"] if given else ["path", "offset", "size"]
    rows = blocks.select(F.col("path").cast("string").alias("path"), F.col("block").cast("long").alias("block"), *[c for c in source if c != "path"])
    if not given:  # in order within a task, so that a file is opened once
        rows = rows.sortWithinPartitions("path", "block")
    return rows.mapInArrow(run, "path string, block long, tokens long, separators long, head long, tail long, inner array<bigint>")


def _scanned(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add docs_before (separators in earlier rows) and carry (tokens since the
    last separator in earlier rows), both within ``group``."""
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # tails since the last row with a separator: running sum less its value there
    rows = rows.withColumn("_sum", F.sum("tail").over(upto))
    mark = F.when(F.col("separators") > 0, F.col("_sum") - F.col("tail"))
    return (
        rows.withColumn("docs_before", F.coalesce(F.sum("separators").over(earlier), F.lit(0)))
        .withColumn("carry", F.coalesce(F.sum("tail").over(earlier), F.lit(0)) - F.coalesce(F.last(mark, ignorenulls=True).over(earlier), F.lit(0)))
        .drop("_sum")
    )


def token_counts(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """path, doc_index (from 0, in file order), n_tokens, open."""
    rows = checkpointed(summaries(blocks, separator, width))  # files are read once; a row a block from here on
    rows = rows.withColumn("run", F.floor(F.col("block") / RUN))
    inside = _scanned(rows, ["path", "run"], "block")
    # a run's summary is a block's: separators, and the tokens after its last
    runs = inside.groupBy("path", "run").agg(
        F.sum("separators").alias("separators"),
        F.max(F.struct("block", F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("tail")))["tail"].alias("tail"),
    )
    runs = _scanned(runs, ["path"], "run").select(
        F.col("path").alias("p"), F.col("run").alias("r"), F.col("docs_before").alias("docs_run"), F.col("carry").alias("carry_run"),
        (F.lead("run").over(Window.partitionBy("path").orderBy("run")).isNull()).alias("last_run"),
    )
    rows = inside.join(runs, (inside["path"] == runs["p"]) & (inside["run"] == runs["r"]))
    carry = F.col("carry") + F.when(F.col("docs_before") == 0, F.col("carry_run")).otherwise(F.lit(0))
    last = F.col("last_run") & F.lead("block").over(Window.partitionBy("path", "run").orderBy("block")).isNull()
    rows = rows.withColumn("from", carry).withColumn("index", F.col("docs_run") + F.col("docs_before")).withColumn("is_last", last)
    closed = F.when(F.col("separators") > 0, F.concat(F.array(F.col("from") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    ended = rows.select("path", "index", F.posexplode(closed).alias("pos", "n_tokens")).select(
        "path", (F.col("index") + F.col("pos")).alias("doc_index"), "n_tokens", F.lit(False).alias("open")
    )
    rest = F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("from") + F.col("tail"))
    left = rows.where("is_last").select("path", (F.col("index") + F.col("separators")).alias("doc_index"), rest.alias("n_tokens"), F.lit(True).alias("open"))
    return ended.union(left.where("n_tokens > 0"))
