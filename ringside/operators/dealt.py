"""Both sides of every bout brought together from several tables.

Wide rows of doubles are large when they are dealt one by one, so they are dealt as
pieces of compressed columns: each batch is cut by the task its bouts belong to. A
task unpacks its pieces, puts the sides in order and lays them side by side; all that
is read of a bout is then in one row, and nothing of it is dealt again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import _dealt

#: Bouts of a task, and rows that are cut at once.
BOUTS, ROWS = 60_000, 131_072
_PIECES = "task int, kind int, size int, packed binary"


class UnpairedError(ValueError):
    """A bout hasn't exactly two sides in one of the tables, or is missing there."""


def _pieces(df: DataFrame, kind: int, keys: list[int]) -> DataFrame:
    rows = df.withColumn("_task", F.pmod(F.xxhash64("fight_url"), F.lit(len(keys))).cast("int"))

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by([("_task", "ascending"), ("fight_url", "ascending")]).combine_chunks()
        task, t = t.column("_task").to_numpy(), t.drop_columns(["_task"])
        own, starts = np.unique(task, return_index=True)
        found = []
        for k, at, to in zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(task)], strict=True):
            raw = t.slice(at, to - at).combine_chunks().to_batches()[0].serialize()
            found.append((keys[k], kind, raw.size, pa.Codec("zstd").compress(raw, asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["task", "kind", "size", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return rows.mapInArrow(run, _PIECES)


def laid(tables: list[pa.Table], both: bool) -> pa.Table:
    """fight_url and side, then each table's columns: ``x_`` of the side, ``y_`` of the
    other; of tables without sides as they are. A row a side, or the first side's."""
    tables = [t.sort_by([(c, "ascending") for c in ("fight_url", "side") if c in t.column_names]).combine_chunks() for t in tables]
    first = next(t for t in tables if "side" in t.column_names)
    n = first.num_rows
    url = first.column("fight_url")
    ones = url.take(pa.array(np.arange(0, n, 2)))
    if n % 2 or not np.array_equal(first.column("side").to_numpy(), np.arange(n) % 2) or not ones.equals(url.take(pa.array(np.arange(1, n, 2)))):
        raise UnpairedError("a bout hasn't two sides")
    x = np.arange(n) if both else np.arange(0, n, 2)
    columns, names = [url.take(pa.array(x)), first.column("side").take(pa.array(x))], ["fight_url", "side"]
    for t in tables:
        sided = "side" in t.column_names
        if not t.column("fight_url").equals(url if sided else ones) or (sided and not t.column("side").equals(first.column("side"))):
            raise UnpairedError("a bout is missing")
        for c in t.column_names:
            if c in ("fight_url", "side"):
                continue
            for prefix, at in (("x_", x), ("y_", x ^ 1)) if sided else (("", x // 2),):
                columns.append(t.column(c).take(pa.array(at)))
                names.append(prefix + c)
    return pa.table(columns, names=names)


def side_by_side(frames: list[DataFrame], expected: int, both: bool) -> DataFrame:
    """``laid`` over all bouts. ``frames``: fight_url, side (int; or none, a row a bout)
    and plain columns; each has all bouts. ``expected``: about how many bouts there are."""
    frames = [f.select(*[F.col(c).cast("int").alias(c) if c == "side" else F.col(c) for c in f.columns]) for f in frames]
    tasks = max(12, -(-expected // BOUTS))
    keys = _dealt(frames[0].sparkSession, tasks)
    rows = reduce(DataFrame.union, [_pieces(f, kind, keys) for kind, f in enumerate(frames)])
    fields = [StructField("fight_url", frames[0].schema["fight_url"].dataType), StructField("side", next(f.schema["side"].dataType for f in frames if "side" in f.columns))]
    for f in frames:
        own = [c for c in f.schema if c.name not in ("fight_url", "side")]
        fields += [StructField(p + c.name, c.dataType) for c in own for p in (("x_", "y_") if "side" in f.columns else ("",))]
    schemas = [f.limit(0).toArrow().schema for f in frames]

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        if sorted(held) != list(range(len(schemas))):
            raise UnpairedError("a bout is missing")
        tables = []
        for kind, schema in enumerate(schemas):
            raw = (pa.Codec("zstd").decompress(p, size) for size, p in held.pop(kind))
            tables.append(pa.Table.from_batches([pa.ipc.read_record_batch(r, schema) for r in raw], schema))
        yield from laid(tables, both).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}
        for b in batches:
            for t, kind, size, p in zip(*(b.column(c).to_pylist() for c in ("task", "kind", "size", "packed")), strict=True):
                if t != task:
                    if held:
                        yield from told(held)
                    task, held = t, {}
                held.setdefault(kind, []).append((size, p))
        if held:
            yield from told(held)

    return rows.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(run, StructType(fields))
