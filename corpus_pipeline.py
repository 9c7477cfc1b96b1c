"""A text corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with
the columns of ``documents``; the last returns the encoded corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.llm import bpe, langid, mixing, pii, simhash
from ringside.llm.catalog import tokenizer
from ringside.llm.common import checkpointed, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go."""
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source contributes its share of words; documents may come twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian 32-bit), checked by decoding."""
    path, pattern = tokenizer()
    back = bpe.encode(docs.select("doc_id", "source", "text"), path, pattern, packed=True, decoded_col="decoded", drop=("text",))
    return back.select(
        "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Neither fingerprints nor merges can be written in SQL; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each one's rows checkpointed."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
