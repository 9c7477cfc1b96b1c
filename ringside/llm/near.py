"""Near-duplicate texts by Jaccard likeness of 5-word shingles, 0.8 or more.

Words are those of ``simhash``; a text's set holds the XXH64 hashes (seed 42) of
its 5-word shingles (the whole sequence where there are fewer words; one shingle
for a text without words). SimHash bits don't bound this likeness: pairs at 0.8
differ in about 10 of 64 bits, and balls that wide meet everywhere. So candidates
share one of 40 bands of 5 MinHash values each; a pair at exactly 0.8 shares none
with probability (1 - 0.8^5)^40 = 1.3e-7. Every candidate is verified on the
whole sets.

A first pass keeps large groups linear: each text is compared with one text,
that of the texts it meets whose bands are shared most. In a group of copies of
one text that is the text itself: its copies keep most of its bands and share
few with each other. One text of each component stays. Then all pairs of the
texts that are left and share a rare shingle are compared. No two candidates that
stay are alike, and whatever goes is linked to a text that stays.

Defined results: null text counts as empty, and texts without words are alike;
copies of a text are one text; extra columns are ignored; very long texts are
hashed whole, their MinHash values in chunks; of texts whose bands are shared
equally, the one with more shingles leads, then the one with the greater hash.
An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, settled

SHINGLE = 5
SEED = 42
BANDS, ROWS = 40, 5
_CHUNK = 256
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: str | None) -> np.ndarray:
    """The set of shingle hashes of one text, sorted."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII only, as in simhash
    if len(words) <= SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=len(grams)))


def bands_of(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of the set's MinHash values."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype="<u8")
    for at in range(0, len(shingles), _CHUNK):
        h = shingles[at : at + _CHUNK, None]
        np.minimum(low, ((h ^ _MIX[0]) * _MIX[1]).min(axis=0), out=low)
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def banded(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), n (shingles) and bands of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bands = [], []
            for t in b.column("text"):
                found = shingles_of(t.as_py())
                n.append(len(found))
                bands.append(bands_of(found))
            columns = [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "bands"])
            give_back()

    return rows.mapInArrow(run, "doc_id long, th long, n long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th, text = b.column("th"), b.column("text")
            for i in range(b.num_rows):  # sets can be larger than their texts: one at a time
                found = pa.array([shingles_of(text[i].as_py()).view("<i8")], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([th.slice(i, 1), found], names=["th", "grams"])
            give_back()

    return texts.mapInArrow(run, "th long, grams array<long>")


def _may_be_alike() -> Column:
    return 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")


def crowded(one: DataFrame) -> DataFrame:
    """th, n, point and size (texts at the point) of the texts that share a
    point with another text."""
    points = one.select("th", "n", F.explode("bands").alias("point"))
    # written out, so that a join on a point that many texts hold can be split
    shared = settled(points.groupBy("point").agg(F.count("*").alias("size")).where("size > 1"))
    return settled(points.join(shared, "point"))


def with_leader(points: DataFrame) -> DataFrame:
    """A pair (a, b) for each text that meets one whose bands are shared more:
    with the first by that among the leaders of its points."""
    rank = points.groupBy("th").agg(F.struct(F.sum("size").alias("shared"), F.first("n").alias("n"), F.col("th")).alias("rank"))
    ranked = settled(points.select("th", "point").join(rank, "th"))
    leader = settled(ranked.groupBy("point").agg(F.max("rank").alias("lead")))
    pairs = ranked.join(leader, "point").where("lead > rank").select("th", "lead", F.col("lead.n").alias("na"), F.col("rank.n").alias("nb"))
    pairs = pairs.where(_may_be_alike()).groupBy("th").agg(F.max("lead").alias("lead"))
    return pairs.select(F.least("th", "lead.th").alias("a"), F.greatest("th", "lead.th").alias("b"))


def with_all(sets: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of these sets that may reach 0.8: with shingles
    in one order, the rarest first, such sets share one of their first
    n / 5 + 1, and what follows there is long enough. Exact; a passage that
    many texts hold comes last and so brings no pairs."""
    grams = sets.select("th", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    often = settled(grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    by_text = grams.join(often, "g").groupBy("th", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("t"))
    placed = by_text.select("th", "n", (F.col("n") - F.size("t")).alias("alone"), F.posexplode("t").alias("pos", "x"))
    placed = placed.select("th", "n", (F.col("alone") + F.col("pos")).alias("at"), F.col("x.g").alias("g")).where("at <= floor(n / 5)")
    placed = settled(placed)
    a = placed.select("g", F.col("th").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    b = placed.select("g", F.col("th").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    rest = 9 * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return a.join(b, "g").where("a < b").where(_may_be_alike()).where(rest >= 4 * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def sets_of(docs: DataFrame, one: DataFrame, points: DataFrame) -> DataFrame:
    """th and the set of each text that has a point here. One row of a text is
    looked up by its id and text, so copies of a text aren't gathered."""
    keys = one.join(points.select("th").distinct(), "th", "left_semi").select(F.xxhash64("first.doc_id", "th").alias("k"), "th")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "th")).join(keys, ["k", "th"], "left_semi").dropDuplicates(["k", "th"])
    return settled(_sets(rows.select("th", "text")))


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard likeness of 0.8 or more."""
    both = pairs.join(sets.select(F.col("th").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("th").alias("b"), F.col("grams").alias("gb")), "b")
    met = F.size(F.array_intersect("ga", "gb"))
    return both.where(9 * met >= 4 * (F.size("ga") + F.size("gb"))).select("a", "b")
