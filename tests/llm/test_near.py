"""SimHash components and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from ringside.llm import common, fingerprint, simhash


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[n], t, "z") for n, (i, t) in enumerate(enumerate(texts))], "doc_id long, text string, fp string")


def plain_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, radius=2):
    seen, out = set(), {}
    for start in sorted(fps):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            a = todo.pop()
            for b in fps:
                if b not in group and (fps[a] ^ fps[b]).bit_count() <= radius:
                    group.add(b)
                    todo.append(b)
        seen |= group
        out |= dict.fromkeys(group, min(group))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "Ünï ÀB one", "one", "One", "a b", "A\tb", "x y z", "x y z q"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 200, 400]))]
        texts += [" ".join(base)] * rng.choice([1, 3])
        for _ in range(4):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    return texts


def test_components(spark):
    texts = corpus()
    want = {i: plain_fp(t) for i, t in enumerate(texts)}
    groups = plain_components(want)
    got = simhash.digests(docs(spark, texts)).collect()
    assert len(got) == len(texts) and len(set(groups.values())) < len(texts) - 10
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{want[r.doc_id]:016x}", groups[r.doc_id])


def test_long_chains(spark):
    """A path of fingerprints, two bits apart each: one component of great depth."""
    fps, at = [0], 0
    for i in range(0, 62, 2):
        at |= 3 << i
        fps.append(at - (1 << 64) if at >> 63 else at)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps + fps], "fp long"))
    comp = simhash.components(edges).collect()
    assert len({r.root for r in comp}) == 1 and {r.node for r in comp} == set(fps)
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_one_of_each_group_stays(spark):
    texts = ["same words in here now", "same words in here now", "another text altogether it is", None, "", "same words in here now"]
    kept = simhash.deduplicated(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3] and kept[0].fp == "z"
    again = simhash.deduplicated(docs(spark, ["t t t t", "t t t t", "u u u u"], ids=[5, 5, None])).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in again) == [(False, 5), (True, None)]
    none = docs(spark, ["x"]).limit(0)
    assert simhash.deduplicated(none).count() == 0 and simhash.digests(none).count() == 0


def test_next_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("doc_id"), F.lit(1).alias("h")).repartition(7)
    got = {r.doc_id: r.next.doc_id for r in common.global_next(df, ["doc_id"], ["doc_id"]).collect()}
    assert got == {i: (i + 1) % 1000 for i in range(1000)}


TEXTS = ["alpha beta gamma\n\ndelta epsilon zeta eta", "delta epsilon zeta eta\nalpha beta gamma", None, "", "one", " ".join(f"w{i}" for i in range(200)), "é🎉" * 50, "x\n" * 3000]


def test_digests(spark):
    got = {r.doc_id: r for r in fingerprint.digests(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        own, after = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1  # paragraphs in another order
    assert got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1 and len({r.fingerprint for r in got.values()}) == 6
    assert got[5].near_edited > 0.5 > got[5].near_next


def plain_lanes(text):
    """8 uniform lanes, the number of shingles, and for each bit the shingles that have it."""
    lanes = [0] * 72
    for p in (text or "").split("\n"):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", p) if w]
        if not words:
            continue
        for s in range(4):
            h = spark_hash(s, p)
            lanes[2 * s] += h & 0xFFFFFFFF
            lanes[2 * s + 1] += h >> 32
        grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 3 else [[" ".join(words)]]
        for g in grams:
            h = spark_hash(*g)
            lanes[8] += 1
            for bit in range(63):
                lanes[9 + bit] += h >> (21 * (bit // 21) + bit % 21) & 1
    return [x & 0xFFFFFFFF for x in lanes[:8]] + lanes[8:]


def spark_hash(*values):
    """Spark's chained xxhash64 (seed 42; whole numbers as 4 bytes), unsigned."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(4, "little") if isinstance(v, int) else v.encode(), seed)
    return seed


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * c - v[8] for c in v[9:]] for v in (a, b))
    whole = sum(i * i for i in x) + sum(i * i for i in y)
    return max(0.0, min(1.0, 1 - sum((i - j) ** 2 for i, j in zip(x, y, strict=True)) / whole)) if whole else 0.0


def plain_shown(lanes):
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in lanes[:9]) + "".join(f"{x & 0xFFFFFF:06x}" for x in lanes[9:])


def test_fingerprints_against_plain_sums(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Ünï", "x", "🎉", "delta"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 6))) for _ in range(40)] + [None, "", "one", "a b c\td e\x0bf"]
    want = [plain_lanes(t) for t in texts]
    for r in fingerprint.digests(docs(spark, texts).withColumn("lanes", F.lit(0)).withColumn("h1", F.lit(0))).collect():
        own, after = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        edited = plain_lanes(own[: len(own) - len(own) // 4] + after[: len(own) // 4])
        a = want[r.doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (plain_shown(a), plain_shown(edited))
        assert r.near_edited == pytest.approx(plain_likeness(a, edited)) and r.near_next == pytest.approx(plain_likeness(a, want[(r.doc_id + 1) % len(texts)]))


def test_ids_missing_and_rows_repeated(spark):
    got = fingerprint.digests(docs(spark, ["b", "b", "a c", "d"], ids=[7, 7, None, 7])).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 1 and len({(r.doc_id, r.edited_sha256) for r in got}) == 3
    (alone,) = fingerprint.digests(docs(spark, ["abcd efgh"])).collect()
    assert alone.near_next == 1 and fingerprint.digests(docs(spark, ["x"]).limit(0)).count() == 0


def test_insert_and_delete(spark):
    df = docs(spark, ["p one two\nq three", "p one two", "q three"])
    v = {r.doc_id: r.lanes for r in fingerprint.fingerprints(df).collect()}
    many = docs(spark, ["\n".join(f"word{i} of a line" for i in range(50)), "\n".join(f"word{i} of a line" for i in range(49)), "word49 of a line"])
    m = {r.doc_id: r.lanes for r in fingerprint.fingerprints(many).collect()}
    lanes = spark.createDataFrame([(m[1], m[2], m[0])], "a array<long>, b array<long>, w array<long>")
    r = lanes.select(fingerprint.insert(F.col("a"), F.col("b")).alias("i"), fingerprint.delete(F.col("w"), F.col("b")).alias("d")).first()
    assert r.i == m[0] and r.d == m[1]  # lane by lane, not only as text
    both = spark.createDataFrame([(v[0], v[1], v[2])], "w array<long>, a array<long>, b array<long>")
    r = both.select(fingerprint.as_text(F.col("w")).alias("w"), fingerprint.as_text(fingerprint.insert(F.col("a"), F.col("b"))).alias("i"), fingerprint.delete(F.col("w"), F.col("b")).alias("d")).first()
    assert r.w == r.i and r.d == v[1]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in (a, b)))
    return len(a & b) / len(a | b)


def test_near_copies_at_a_likeness_of_08_go(spark):
    """Copies with scattered changes, far more than 2 bits apart."""
    rng = random.Random(7)
    texts = []
    for n in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 700]))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.06):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, int(share * len(base)))):
                copy[at] = f"changed{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    alike = {(i, j): jaccard(texts[i], texts[j]) for i in range(len(texts)) for j in range(i + 1, i - i % 5 + 5)}
    far = [p for p, v in alike.items() if 0.8 <= v < 1 and (plain_fp(texts[p[0]]) ^ plain_fp(texts[p[1]])).bit_count() > 2]
    kept = {r.doc_id for r in simhash.deduplicated(docs(spark, texts)).collect()}
    assert len(far) > 30 and not any(i in kept and j in kept for i, j in alike if alike[i, j] >= 0.8)
    groups = {i: {j for p, v in alike.items() if v >= 0.8 and i in p for j in p} for i in range(len(texts))}
    assert all(i in kept or groups[i] for i in range(len(texts))) and all(i in kept for i in groups if not groups[i])
