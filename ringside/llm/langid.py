"""Language identification: known words first, character n-grams for the rest.

Learning: from labelled rows, a bounded sample of them (``max_docs``, the
documents with the smallest hashes in expectation), word counts by language are
aggregated on the cluster; all words of the sample make the model, and the
character n-grams of those words, weighted by their counts, the fallback. The
model's size is bounded by the sample and not by the corpus, so it is broadcast.

Prediction: the letters of a text are cut into lower-cased words. A known word
adds its log frequency in each language; an unseen word is looked up by its
longest n-grams (``max_n``) and, where none is known, by shorter and shorter
ones. The language with the largest sum wins (ties: the first by name); the
score is its posterior with equal priors.

Defined results: null text, or text without a letter, is ``und`` with score 0,
and so is every text where no labelled row was to be had. Only the text is an
input of a prediction. Repeated rows give repeated results, and a document that
is repeated in the sample counts each time. A very long text is scored whole. An
empty table gives an empty result. A column that is there by the name of a
prediction gives way in ``predict``; ``identified`` keeps all columns and reserves
names that begin with ``_rs_``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

UNKNOWN = "und"
_letters = regex.compile(r"\p{L}+").findall


@dataclass(frozen=True)
class Model:
    langs: list[str]
    words: dict[str, int]  # word -> row of word_logs
    word_logs: np.ndarray
    grams: list[dict[str, int]]  # by length; [n][gram] -> row of gram_logs[n]
    gram_logs: list[np.ndarray]


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _logs(keys: list[str], counts: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequency by language; add half an occurrence to each."""
    c = counts + 0.5
    return {k: i for i, k in enumerate(keys)}, np.log(c / c.sum(axis=0)) if len(keys) else c


def _grams_logs(words: list[str], counts: np.ndarray, n: int) -> tuple[dict[str, int], np.ndarray]:
    """The n-grams of all words, weighted by the words' counts."""
    at: dict[str, int] = {}
    gram, word = [], []
    for i, w in enumerate(words):
        for g in grams_of(w, n):
            gram.append(at.setdefault(g, len(at)))
            word.append(i)
    sums = np.zeros((len(at), counts.shape[1]))
    np.add.at(sums, np.array(gram, dtype=np.int64), counts[np.array(word, dtype=np.int64)])
    return _logs(list(at), sums)


def train(labelled: DataFrame, max_docs: int = 2_000, max_n: int = 4) -> Model:
    """Fit on (doc_id, text, lang) rows; rows with a null in any are left out.

    ``max_docs`` bounds the sample, and with it the model: every word of the
    sample is a known word, and every n-gram of those is counted."""
    rows = labelled.where("doc_id is not null and text is not null and lang is not null")
    n = rows.count()
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = rows.where(h < max(1, math.ceil(1_000_000 * max_docs / n))) if n > max_docs else rows
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    found = words.groupBy("lang", "word").count().toPandas()  # the words of max_docs documents at most
    langs, lang = np.unique(found["lang"].to_numpy(dtype=str), return_inverse=True)
    known, word = np.unique(found["word"].to_numpy(dtype=str), return_inverse=True)
    counts = np.zeros((len(known), len(langs)))
    counts[word, lang] = found["count"].to_numpy()
    names = known.tolist()
    by_word, logs = _logs(names, counts)
    fallback = [_grams_logs(names, counts, k) for k in range(1, max_n + 1)]
    return Model(langs.tolist(), by_word, logs, [{}, *[g for g, _ in fallback]], [np.zeros((0, len(langs))), *[m for _, m in fallback]])


class Scorer:
    """Scores texts; keeps the vectors of up to ``cache_words`` unseen words."""

    def __init__(self, model: Model, cache_words: int = 100_000):
        self.model, self.cache_words = model, cache_words
        self.unseen: dict[str, np.ndarray] = {}

    def vector(self, word: str) -> np.ndarray:
        m = self.model
        for n in range(len(m.grams) - 1, 0, -1):
            rows = [m.grams[n][g] for g in grams_of(word, n) if g in m.grams[n]]
            if rows:
                return m.gram_logs[n][rows].mean(axis=0)
        return np.zeros(len(m.langs))

    def score(self, text: str | None) -> tuple[str, float]:
        words = _letters(text.lower()) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        known, unseen = self.model.words, self.unseen
        total = np.zeros(len(self.model.langs))
        rows = list(map(known.get, words))
        seen = np.array([-1 if r is None else r for r in rows])
        total += self.model.word_logs[seen[seen >= 0]].sum(axis=0)
        for word, n in Counter(w for w, r in zip(words, rows, strict=True) if r is None).items():
            if (v := unseen.get(word)) is None:
                if len(unseen) >= self.cache_words:
                    unseen.clear()
                v = unseen[word] = self.vector(word)
            total += n * v
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language and its score to each row, in place of columns
    of these names."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by train()'s parameters

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in texts:
            found = [scorer.score(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "score"])
            give_back()

    # texts go to the workers and only the answers come back
    udf = F.arrow_udf(run, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]), F.ArrowUDFType.SCALAR_ITER)
    rows = df.withColumn("_rs_found", udf(F.col(text_col)))
    kept = [c for c in df.columns if c not in (lang_col, score_col)]
    return rows.select(*kept, F.col("_rs_found.lang").alias(lang_col), F.col("_rs_found.score").alias(score_col))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from (a null id is learnt from by none)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnt(docs: DataFrame, **how) -> Model:
    return train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "text", "lang"), **how)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    return predict(docs.select("doc_id", "text"), learnt(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """The documents whose language is found with a score of at least ``least``.

    Where nothing was to be learnt from, all documents stay."""
    model = learnt(docs, **how)
    if not model.langs:
        return docs
    rows = predict(docs, model, lang_col="_rs_lang", score_col="_rs_score")
    return rows.where((F.col("_rs_lang") != UNKNOWN) & (F.col("_rs_score") >= least)).select(*docs.columns)
