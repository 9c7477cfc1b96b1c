"""The near-duplicate stage leaves no shuffle files of its finished steps."""

from __future__ import annotations

import os
import random
import time

from ringside.llm import simhash


def shuffles(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.split("_")[1] for top in dirs for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def test_finished_shuffles_go(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(100)) for _ in range(20)]
    texts += [f"{t} more" for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, seen, plain = shuffles(spark), [], simhash.components

    def watched(edges):
        seen.append(shuffles(spark) - before)
        return plain(edges)

    monkeypatch.setattr(simhash, "components", watched)
    stays = simhash.deduplicated(rows)
    first, second = seen
    for _ in range(100):  # files are removed beside the run
        if not (left := shuffles(spark) & (first | second)):
            break
        time.sleep(0.1)
    assert first and second - first and not left
    assert stays.count() == 20
