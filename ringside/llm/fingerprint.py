"""Document fingerprints by a homomorphic multiset hash.

Every paragraph (a line that isn't blank) is hashed to a wide vector of whole
numbers, and a text's fingerprint is the sum of its paragraphs' vectors, lane by
lane, modulo powers of two. So the order of paragraphs is of no account, equal
multisets have equal fingerprints, and a paragraph is inserted or deleted by
adding or subtracting its vector.

Lanes of a paragraph:
- 8 of 32 bits, uniform: halves of four seeded 64-bit hashes of the paragraph;
- 1 counting its 3-word shingles (all its words, if fewer);
- 63 counting, for each hash bit, the shingles that have it. Twice such a count
  less the number of shingles is a sum of random signs, so the squared distance
  of two fingerprints estimates how many shingles only one text has, and
  1 - |a - b|^2 / (|a|^2 + |b|^2) the share that both have (cut to 0..1).

Only DataFrame functions are used. The text is shuffled once, by a hash of the
row; the following document is found by ranges (``common.global_next``), and
only the prefix that an edit takes from it is moved.

Defined results: null text counts as empty; a text without words has an
all-zero fingerprint, and two of them are alike (1); the document after the last
is the first, and one document alone follows itself; repeated rows (same doc_id
and text) are one document and each get its result; a null doc_id comes first,
and rows of one doc_id are ordered by a hash of their text; a very long text is
hashed whole, its features summed in chunks of 2^20; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, global_next, text_or_empty

SEEDS = 4
SHINGLE = 3
PER_SUM = 3  # lanes of 21 bits in one 63-bit sum
BITS = 21
LANES = PER_SUM * BITS
_ONES = sum(1 << (BITS * k) for k in range(PER_SUM))
_LOW = (1 << 32) - 1
_CHUNK = 20  # a sum takes at most 2^20 features, so that no 21-bit lane runs over


def features(text: Column) -> Column:
    """struct(m, all): the first m hashes are the paragraphs' (SEEDS each), the rest the shingles'."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))

    def shingles(p: Column) -> Column:
        words = F.filter(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        several = lambda w: F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        )
        return bound(words, lambda w: F.when(F.size(w) > SHINGLE, several(w)).otherwise(F.array(F.xxhash64(F.array_join(w, " ")))))

    def both(ps: Column) -> Column:
        whole = F.flatten(F.transform(ps, lambda p: F.array(*[F.xxhash64(F.lit(s), p) for s in range(SEEDS)])))
        return F.struct((F.size(ps) * SEEDS).alias("m"), F.concat(whole, F.flatten(F.transform(ps, shingles))).alias("all"))

    return bound(paragraphs, both)


def vectors(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and ``lanes`` (array<long>: 8 uniform, 1 count, 63 bit counts) of each
    row; the keys must tell all rows apart."""
    exploded = rows.select(*keys, features(F.col(text_col)).alias("f")).select(*keys, F.col("f.m").alias("m"), F.posexplode_outer("f.all").alias("pos", "h"))
    of_paragraph = F.col("pos") < F.col("m")
    zero = F.lit(0).cast("long")
    sums = []
    for s in range(SEEDS):
        mine = of_paragraph & (F.col("pos") % SEEDS == s)
        sums.append(F.sum(F.when(mine, F.col("h").bitwiseAND(F.lit(_LOW))).otherwise(zero)).alias(f"u{2 * s}"))
        sums.append(F.sum(F.when(mine, F.shiftrightunsigned("h", 32)).otherwise(zero)).alias(f"u{2 * s + 1}"))
    shingle = F.when(~of_paragraph, F.col("h"))
    sums.append(F.count(shingle).alias("n"))
    packed = [F.sum(F.shiftright(shingle, j).bitwiseAND(F.lit(_ONES))).alias(f"s{j}") for j in range(BITS)]
    part = exploded.groupBy(*keys, F.shiftright("pos", _CHUNK).alias("chunk")).agg(*sums, *packed)
    one_lane = (1 << BITS) - 1
    lanes = [F.sum(F.coalesce(F.shiftright(f"s{j}", BITS * k).bitwiseAND(F.lit(one_lane)), zero)) for k in range(PER_SUM) for j in range(BITS)]
    first = [F.sum(f"u{i}").bitwiseAND(F.lit(_LOW)) for i in range(2 * SEEDS)] + [F.sum("n")]
    return part.groupBy(*keys).agg(F.array(*first, *lanes).alias("lanes"))


def as_text(lanes: Column) -> Column:
    """Hex: the uniform lanes and the count modulo 2^32, the bit counts modulo 2^24."""
    wide, bits = F.slice(lanes, 1, 2 * SEEDS + 1), F.slice(lanes, 2 * SEEDS + 2, LANES)
    lane = lambda width: lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << 4 * width) - 1)))), width, "0")
    return F.concat(F.array_join(F.transform(wide, lane(8)), ""), F.array_join(F.transform(bits, lane(6)), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two vectors of lanes alone."""

    def signs(x: Column) -> Column:
        n = F.element_at(x, 2 * SEEDS + 1)
        return F.transform(F.slice(x, 2 * SEEDS + 2, LANES), lambda c: (c * 2 - n).cast("double"))

    def norm(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)

    apart = norm(F.zip_with(signs(a), signs(b), lambda x, y: x - y))
    near = 1 - F.try_divide(apart, norm(signs(a)) + norm(signs(b)))
    same = F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)), same))


def _reduced(lanes: Column) -> Column:
    """Each lane modulo its power of two, as ``vectors`` gives them."""
    masks = F.array(*[F.lit(_LOW)] * (2 * SEEDS), *[F.lit((1 << 62) - 1)] * (1 + LANES))
    return F.zip_with(lanes, masks, lambda x, m: x.bitwiseAND(m))


def insert(lanes: Column, paragraph: Column) -> Column:
    """Lanes after a paragraph with these lanes is added."""
    return _reduced(F.zip_with(lanes, paragraph, lambda x, y: x + y))


def delete(lanes: Column, paragraph: Column) -> Column:
    """Lanes after a paragraph with these lanes is taken away."""
    return _reduced(F.zip_with(lanes, paragraph, lambda x, y: x - y))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and lanes of each different (doc_id, text)."""
    rows = docs.select("doc_id", text_or_empty(text_col).alias("t")).distinct()
    rows = rows.withColumn("k", F.xxhash64("t"))
    return vectors(rows, ["doc_id", "k"], "t").select("doc_id", "lanes")


def digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and likenesses."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keyed = keyed.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64("text", "doc_id").alias("h2"))
    texts = keyed.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])  # the only shuffle of texts
    ids = keyed.select("doc_id", "h1", "h2", F.length("text").cast("long").alias("n")).groupBy("doc_id", "h1", "h2", "n").agg(F.count("*").alias("same"))
    links = global_next(ids, ["doc_id", "h1", "h2"], ["h1", "h2"])
    links = links.select("doc_id", "h1", "h2", "n", "same", F.col("next.h1").alias("g1"), F.col("next.h2").alias("g2"))
    wanted = links.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.floor(F.col("n") / 4).cast("int").alias("take"), "g1", "g2")
    moved = texts.join(wanted, (texts["h1"] == wanted["g1"]) & (texts["h2"] == wanted["g2"]))
    moved = moved.select("k1", "k2", "take", F.expr("substring(text, 1, take)").alias("prefix"))
    edited = texts.join(moved, (texts["h1"] == moved["k1"]) & (texts["h2"] == moved["k2"]))
    edited = edited.select("h1", "h2", "text", F.expr("concat(substring(text, 1, length(text) - take), prefix)").alias("edited"))
    both = edited.select(
        "h1", "h2", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("text").alias("t")), F.struct(F.lit(1).alias("w"), F.col("edited").alias("t")))).alias("x"),
    )
    keys = ["h1", "h2", "edited_sha256", "w"]
    lanes = vectors(both.select("h1", "h2", "edited_sha256", "x.w", "x.t"), keys, "t")
    own = lambda w: F.max(F.when(F.col("w") == w, F.col("lanes")))
    lanes = lanes.groupBy("h1", "h2").agg(own(0).alias("a"), own(1).alias("b"), F.max("edited_sha256").alias("edited_sha256"))
    before = links.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    rows = lanes.join(links.select("h1", "h2", "doc_id", "n", "same"), ["h1", "h2"]).join(before, ["h1", "h2"])
    # each row goes to its own key, and its vector to the key of the row before
    mine = F.struct("doc_id", "n", "same", "edited_sha256", "a", "b")
    none = F.lit(None).cast(lanes.select(F.col("a")).schema["a"].dataType)
    sent = F.array(
        F.struct(F.col("h1").alias("k1"), F.col("h2").alias("k2"), mine.alias("row"), none.alias("c")),
        F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.when(F.lit(False), mine).alias("row"), F.col("a").alias("c")),
    )
    rows = rows.select(F.explode(sent).alias("x")).select("x.*")
    rows = rows.groupBy("k1", "k2").agg(F.first("row", ignorenulls=True).alias("row"), F.first("c", ignorenulls=True).alias("c")).select("row.*", "c")
    rows = rows.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))))
    return rows.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
