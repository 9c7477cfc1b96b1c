"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: A-Z lower-cased, words are runs of anything but ASCII white space,
3-word shingles (repeats included; the whole sequence where there are fewer
words) hashed by XXH64 with seed 42; a bit is 1 where over half of the hashes
have it. A text without words has fingerprint zero and is linked like any other.

Links: two fingerprints within an even radius 2r share a point at distance at
most r from both. Every *distinct* fingerprint emits its ball of radius r (65
points for 64 bits and r = 1); the points are shuffled, and fingerprints that
meet at a point are linked. All that meet at one point are within 2r of each
other, so chaining them in order keeps every component, with no more links than
members; a point meets at most 65 distinct fingerprints, however many copies
the corpus holds. Links are deduplicated and verified bit by bit, and
components are found by alternating large-star and small-star rounds over
checkpointed links.

Defined results: null text counts as empty; repeated rows each get a row; where
no member of a component has a doc_id, component_id is null; extra columns are
left out of the result. Shingles of a very long text are hashed chunk by chunk,
the whole text; a bit set in just half of the hashes is 0. Empty input gives an
empty result. ``deduplicated`` keeps all columns of the documents and reserves
names that begin with ``_rs_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near
from .common import checkpointed, give_back, settled

SHINGLE = 3
SEED = 42
RADIUS = 2
_CHUNK = 1 << 15


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII only, as asked for
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):  # a very long text's shingles aren't all held at once
        part = words[at : min(at + _CHUNK, n) + shingle - 1]
        grams = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter((digest(g, seed) for g in grams), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, th (a hash of the text, to tell rows apart) and fp of each row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint_of(t, shingle, seed) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp, pa.int64())], names=["doc_id", "th", "fp"])
            give_back()

    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def ball(radius: int, bits: int = 64) -> list[int]:
    """Masks of at most ``radius`` bits, as signed integers."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, whose components are those of "differ in at most
    ``radius`` bits" over the distinct values of ``fp``."""
    if radius % 2:
        raise ValueError("the balls of two fingerprints meet exactly for an even radius only")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    points = (
        fps.select("fp").distinct().select("fp", F.explode(masks).alias("mask"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    )
    before = F.lag("fp").over(Window.partitionBy("point").orderBy("fp"))
    return (
        points.select(before.alias("a"), F.col("fp").alias("b"))
        .where("a is not null")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node of
    its component. Alternates large-star and small-star until nothing moves."""
    edges = checkpointed(edges)
    size, seen = edges.count(), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written out, so that a join on a hub can be split
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), size)
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = checkpointed(large, 2 * size)
        low = checkpointed(large.groupBy("b").agg(F.min("a").alias("m")), size)
        small = large.join(low, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a < b").distinct()
        edges = checkpointed(small, 2 * size)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, th, fp, root and component_id (the smallest doc_id that links
    lead to) of each row; ``keep_th`` is the text hash of the row to keep."""
    fps = checkpointed(fingerprints(docs, SHINGLE, SEED))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th"))
    one = checkpointed(fps.groupBy("fp").agg(first.alias("first")))
    star = components(links(one, radius))
    linked = one.join(star, one.fp == star.node).select("fp", "root", "first")
    lead = linked.groupBy("root").agg(F.min("first").alias("lead"))
    linked = linked.join(lead, "root").select("fp", "root", "lead")
    by_fp = checkpointed(
        one.join(linked, "fp", "left").select(
            "fp",
            F.coalesce("root", "fp").alias("root"),
            F.coalesce("lead.doc_id", "first.doc_id").alias("component_id"),
            F.when(F.col("lead").isNull(), F.col("first.th")).otherwise(F.col("lead.th")).alias("keep_th"),
        )
    )
    return fps.join(by_fp, "fp").select("doc_id", "th", "fp", "root", "component_id", "keep_th")


def digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _leads(one: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``one`` (a row for each text) that stay: those without a
    link, and of each component the one that comes first."""
    star = components(edges)
    linked = one.join(star, one.th == star.node).select("root", "first")
    lead = linked.groupBy("root").agg(F.min("first").alias("lead")).select(F.col("lead.th").alias("th"))
    gone = star.select(F.col("node").alias("th")).join(lead, "th", "left_anti")
    return settled(one.join(gone, "th", "left_anti"))


def candidates(docs: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of text hashes that SimHash links, on the shingles of
    ``near``: a star over the texts of one fingerprint, and the links of fingerprints."""
    fps = settled(fingerprints(docs, near.SHINGLE, near.SEED).groupBy("th").agg(F.first("fp").alias("fp")))
    lead = settled(fps.groupBy("fp").agg(F.min("th").alias("lead")))
    same = fps.join(lead, "fp").where("th > lead").select(F.col("lead").alias("a"), F.col("th").alias("b"))
    met = links(lead).join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    return settled(same.union(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates (5-word shingles, likeness 0.8
    or more): the one with the smallest doc_id (a row with an id before one
    without; repeated ids by text hash). SimHash links give the first candidates;
    since its bits don't bound the likeness, those of ``near`` follow. All are
    verified on whole sets."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("first")
    one = settled(near.banded(docs).groupBy("th").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands")))
    points = near.crowded(one)
    linked = candidates(docs)
    sets = near.sets_of(docs, one, points.select("th").union(linked.select(F.explode(F.array("a", "b")).alias("th"))))
    one = _leads(one, settled(near.verified(sets, linked.union(near.with_leader(points)).distinct())))
    sets = sets.join(near.crowded(one).select("th").distinct(), "th", "left_semi")  # who meets no other any more stays
    one = _leads(one, settled(near.verified(sets, near.with_all(sets))))
    kept = one.select(F.xxhash64("first.doc_id", "th").alias("_rs_k"), F.col("th").alias("_rs_th"))
    # keys without nulls: rows are dealt once, for the join and for repeated rows
    rows = docs.withColumn("_rs_th", F.xxhash64("text")).withColumn("_rs_k", F.xxhash64(F.col("doc_id").cast("long"), "_rs_th"))
    return rows.join(kept, ["_rs_k", "_rs_th"], "left_semi").dropDuplicates(["_rs_k", "_rs_th"]).select(*docs.columns)
