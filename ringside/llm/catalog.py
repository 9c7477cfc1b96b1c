"""Queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprint, langid, mixing, pii, simhash, tokenscan, topk, urls
from .common import table
from .oracles import SQL

RANKS_FILE = "byte_bpe_50k.tiktoken"
SEPARATOR = 50256  # free in the rank file


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern; the path can be set by RINGSIDE_BPE_RANKS."""
    import public_tokenizers

    return os.environ.get("RINGSIDE_BPE_RANKS") or public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, by the 50k rank file."""
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans of every whole text."""
    return pii.digests(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text, and their likenesses."""
    return fingerprint.digests(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule, verdict and template of every page."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """size, source_size, target and words taken of every document."""
    return mixing.digests(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, file, doc_index: all documents' ids are written to flat
    files without an index, and counted there by separator scan."""
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer(), packed=True, drop=("text",))
    return tokenscan.counted(ids, SEPARATOR)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20."""
    return topk.digests(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every whole text, learnt from four folds of five."""
    return langid.digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text."""
    return simhash.digests(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant's rendering of every conversation, by chunk, as digests."""
    return chat.digests(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (
        op1_byte_bpe, op2_pii, op3_fingerprints, op4_url_filters, op5_mixing,
        op6_token_counts, op7_topk, op8_language_id, op9_simhash, op10_chat,
    )
    return {f.__name__: f for f in all_of}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
