"""Chat formatting: every participant's perspective of a many-party dialogue.

For each conversation and each participant (each role but ``system``) the whole
dialogue is rendered with that speaker as the assistant and all others as named
users; system turns stay system turns. The mask lists the code-point ranges
(end exclusive) of what the speaker says, the part a model is trained on.

A rendering is one text, kept in ordered chunks of ``CHUNK`` turns so that an
endless conversation isn't gathered in one task: the texts of a speaker's chunks,
joined in order, are the dialogue, and ``first_char`` and the mask count from its
beginning. Every chunk is rendered for every participant, silent there or not.
Turns are ordered by ranges and numbered by a pass over each range; offsets are
prefix sums over the chunks' lengths.

Format of a turn: <|im_start|>ROLE[ name=NAME]\\nTEXT<|im_end|>\\n. In texts and
names the mark ``<|`` is written ``< |``, so no text can forge a turn.

Defined results: turns are ordered by turn (null first), then role and text; null
text counts as empty; a null or blank role is the participant ``unknown``; rows
with a null conv_id are one conversation; repeated rows are repeated turns; a
conversation of system turns only gives nothing; a very long text is one turn,
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, placed

CHUNK = 256
RUN = 4096  # chunks that one window sums
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _named(role: Column) -> Column:
    return F.concat(F.lit("user name="), _safe(role))


def _numbered(turns: DataFrame) -> DataFrame:
    """conv, role, text and ``no``, the turn's place in its conversation."""
    order = ["conv", "turn", "role", "text"]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, -1
        for b in batches:
            at = []
            for conv in b.column("conv").to_pylist():
                n = n + 1 if conv == last else 0
                last = conv
                at.append(n)
            kept = [b.column(c) for c in ("conv", "role", "text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=["conv", "role", "text", "part", "at"])

    kept = [rows.schema[c] for c in ("conv", "role", "text")]
    rows = checkpointed(rows.mapInArrow(run, T.StructType([*kept, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only a range's first conversation can have begun before it: a row a range at most
    begun = rows.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(earlier)).where("base > 0").drop("n")
    return rows.join(F.broadcast(begun), ["conv", "part"], "left").select("conv", "role", "text", (F.col("at") + F.coalesce("base", F.lit(0))).alias("no"))


def _before(chunks: DataFrame) -> DataFrame:
    """Add first_char: the characters of the speaker's earlier chunks, summed
    within runs of ``RUN`` chunks and over the runs."""
    rows = chunks.withColumn("run", F.floor(F.col("chunk") / RUN))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv", "speaker", "run").agg(F.sum("chars").alias("chars"))
    runs = runs.select("conv", "speaker", "run", F.coalesce(F.sum("chars").over(earlier(["conv", "speaker"], "run")), F.lit(0)).alias("base"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("chars").over(earlier(["conv", "speaker", "run"], "chunk")), F.lit(0)))
    return rows.join(runs, ["conv", "speaker", "run"]).select("conv", "speaker", "chunk", (F.col("base") + F.col("inside")).alias("first_char"))


def perspectives(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, speaker, chunk, n_turns, first_char, text, mask (array of struct start, end)."""
    role = F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))
    turns = conversations.select(
        F.struct("conv_id").alias("conv"),  # a struct is equal to another with a null in the same place
        F.col("turn").alias("turn"), F.when(role == "", "unknown").otherwise(role).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = _numbered(turns).withColumn("chunk", F.floor(F.col("no") / chunk))
    # lengths as seen by who never speaks, and what a speaker's own turns have less
    seen = F.length(F.when(F.col("role") == SYSTEM, SYSTEM).otherwise(_named(F.col("role")))) + F.length(_safe(F.col("text"))) + len(START) + 1 + len(END)
    by_chunk = turns.groupBy("conv", "chunk").agg(F.sum(seen.cast("long")).alias("seen"))
    own = turns.where(F.col("role") != SYSTEM).groupBy("conv", "chunk", F.col("role").alias("speaker")).agg(
        F.sum((F.length(_named(F.col("role"))) - len("assistant")).cast("long")).alias("less")
    )
    own = checkpointed(own)  # a row for each speaker of a chunk
    lengths = own.select("conv", "speaker").distinct().join(by_chunk, "conv").join(own, ["conv", "chunk", "speaker"], "left")
    lengths = _before(lengths.select("conv", "speaker", "chunk", (F.col("seen") - F.coalesce("less", F.lit(0))).alias("chars")))
    chunks = turns.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("no", "role", "text"))).alias("turns"))
    rows = chunks.join(lengths, ["conv", "chunk"])
    mine = lambda t: t["role"] == F.col("speaker")

    def piece(t: Column) -> Column:
        kind = F.when(t["role"] == SYSTEM, SYSTEM).when(mine(t), "assistant").otherwise(_named(t["role"]))
        head = F.concat(F.lit(START), kind, F.lit("\n"))
        body = _safe(t["text"])
        return F.struct(F.concat(head, body, F.lit(END)).alias("text"), F.length(head).alias("head"), F.length(body).alias("body"), mine(t).alias("own"))

    rows = rows.select("conv", "speaker", "chunk", "first_char", F.transform("turns", piece).alias("pieces"))
    said = F.filter(placed(F.col("pieces"), lambda p: F.length(p["text"])), lambda x: x["item"]["own"])

    def span(x: Column) -> Column:
        begin = F.col("first_char") + x["at"] + x["item"]["head"]
        return F.struct(begin.alias("start"), (begin + x["item"]["body"]).alias("end"))

    return rows.select(
        F.col("conv.conv_id").alias("conv_id"), "speaker", "chunk", F.size("pieces").cast("long").alias("n_turns"), "first_char",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"), F.transform(said, span).alias("mask"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    rows = perspectives(conversations)
    listed = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rows.select("conv_id", "speaker", "chunk", "n_turns", "first_char", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), listed.alias("mask"))
