"""The whole pipeline against plain Python, stage by stage."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline

from .test_bpe import expected
from .test_near import jaccard
from .test_pii import plain_rewritten, plain_search
from .test_rest import plain_language, plain_model, plain_targets

STEMS = {"en": ["the", "house", "with", "ing", "water"], "de": ["der", "haus", "mit", "ung", "wässer"], "fr": ["le", "maison", "avec", "tion", "été"]}


def corpus():
    """Documents in three languages with copies, near copies, personal data, and rows that no language fits."""
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        lang = rng.choice(list(STEMS))
        words = ["".join(rng.choices(STEMS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(60, 80))]
        if rng.random() < 0.3:
            words.insert(rng.randrange(30), rng.choice(["p{}@a.example", "10.1.{}.4"]).format(rng.randrange(100)))
            words.insert(rng.randrange(30), "telling")
        rows += [(" ".join(words), lang)] * rng.choice([1, 1, 2, 3])
        if rng.random() < 0.4:  # one text alike at most, so that a group has no chains
            near = list(words)
            near[rng.randrange(len(near))] += "x"
            rows += [(" ".join(near), lang)] * rng.choice([1, 2])
    rows += [(None, "en"), ("", "de"), ("12 34", "fr")]
    rng.shuffle(rows)
    return [(i, t, x, rng.choice(["a", "b", "b", "c", None]), len(t or "")) for i, (t, x) in enumerate(rows)]


def copies_taken(rows):
    """Copies of each document: systematic sampling over the order by source, size and id."""
    size = lambda t: len(t.split())
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    target, out, upto = plain_targets(sizes), {}, defaultdict(int)
    for i, t, _, s, _ in sorted(rows, key=lambda r: (r[3] is None, r[3] or "", size(r[1]), r[0])):
        unit = math.floor(target[s] / sizes[s] * 2**24 + 0.5)
        start = int(hashlib.md5(f"mix:{s or ''}".encode()).hexdigest()[:6], 16) + upto[s]
        out[i] = (start + unit) // 2**24 - start // 2**24
        upto[s] += unit
    return out


def plain_stages(rows):
    langs, logs = plain_model([r[:3] for r in rows if zlib.crc32(str(r[0]).encode()) % 5])
    told = {r[0]: plain_language(r[1], langs, logs) for r in rows}
    rows = [r for r in rows if told[r[0]][0] != "und" and told[r[0]][1] >= 0.5]
    yield rows
    kept = []
    for r in rows:  # ids ascend
        if all(jaccard(r[1], k[1]) < 0.8 for k in kept):
            kept.append(r)
    rows = kept
    yield rows
    rows = [(i, new := plain_rewritten(t, spans), x, s, len(new)) for (i, t, x, s, _), spans in zip(rows, plain_search([r[1] for r in rows]), strict=True)]
    yield rows
    taken = copies_taken(rows)
    rows = [r for r in rows for _ in range(taken[r[0]])]
    yield rows
    packed = [(i, s, expected(t), t) for i, t, _, s, _ in rows]
    yield [(i, s, len(ids), np.array(ids, dtype="<u4").tobytes(), hashlib.sha256(t.encode()).hexdigest()) for i, s, ids, t in packed]


def test_run_equals_plain_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    stages = list(plain_stages(rows))
    assert len(rows) > len(stages[0]) > len(stages[1]) + 20 and sum(a[1] != b[1] for a, b in zip(stages[1], stages[2], strict=True)) > 20
    assert any("[" not in b[1] and "telling" not in b[1] and "telling" in a[1] for a, b in zip(stages[1], stages[2], strict=True)) or any("[WORD]" in r[1] for r in stages[2])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], stages, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, want)), name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, str(r.source), r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got) == sorted((i, str(s), *more) for i, s, *more in stages[4])
    assert all(r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() for r in got)
