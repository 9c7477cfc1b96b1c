"""The near-duplicate stage begins with the links that SimHash gives."""

from __future__ import annotations

import random

from ringside.llm import near, simhash


def test_stage_uses_the_fingerprints_links(spark, monkeypatch):
    rng = random.Random(4)
    words = [rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(rng.choice("xyz") + str(rng.randrange(90)) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [simhash.fingerprint_of(t, near.SHINGLE, near.SEED) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= simhash.RADIUS
    assert simhash.candidates(rows).count() == 1
    # no pair comes from the other passes
    monkeypatch.setattr(near, "with_leader", lambda points: points.selectExpr("th AS a", "th AS b").limit(0))
    monkeypatch.setattr(near, "with_all", lambda sets: sets.selectExpr("th AS a", "th AS b").limit(0))
    assert sorted(r.doc_id for r in simhash.deduplicated(rows).collect()) == [0, 2]


def test_links_below_the_likeness_do_not_count(spark):
    """Fingerprints may agree where texts don't: such a pair stays."""
    texts = ["a b c d e f", "a b c d e g"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.deduplicated(rows).count() == 2
