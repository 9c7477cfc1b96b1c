"""Personal data: pattern spans, and terms that give protected values away.

Base spans are found by pattern (email, ip, card, phone). The distinct values
found are the protected entities, and so are their groups (email domain, first
half of an ip, card issuer, start of a phone number) and kinds, by which values
too rare to be measured alone are measured together. How strongly a term reveals an entity is
measured on the corpus: with document counts over all rows, the pointwise
mutual information of term and entity is compared with the information of the
entity itself, log2(N / df(entity)). The quotient is 1 where the term occurs in
no document without the entity. Where at least ``support`` different texts hold
both, a quotient of ``generalise_at`` or more makes the term disclosing: in the
documents that hold the entity it is generalised to its kind of word, or removed
where the quotient reaches ``remove_at``. Documents without a base span are left
as they are.

Only DataFrame functions are used. Pairs of entity and term are formed inside a
document only, for entities of at least ``support`` different texts, and are
summed before they are shuffled; copies of a text are searched once and weighed
by their number. The texts that hold a base span are written out once, with
their spans, and all that follows reads those; terms go by a 64-bit hash.

Defined results: null text counts as empty (and stays null when rewritten);
repeated rows give repeated results; positions are code points, end exclusive.
Very long texts are searched whole, spans in blocks (``common.placed``), so the
work isn't quadratic in a text's spans. Ties: of spans with one start, the kind
listed first comes first; a term that tells of several entities is removed if
any of them asks for it. An empty table gives an empty result. Columns other
than doc_id and text are ignored by ``digests`` and kept by ``sanitised``, which
reserves names that begin with ``_rs_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, checkpointed, in_blocks, placed, text_or_empty

#: Kinds in the order of the contract; each with its pattern, written so that
#: no start is tried inside a run that has failed (linear on long runs), and a
#: cheap test that every match passes. Fixed values.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
WORD = r"[\p{L}\p{N}]++"
SUPPORT = 3
GENERALISE_AT = 0.8
REMOVE_AT = 0.999

_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _may_hold(kind: str, text: Column) -> Column:
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
        "card": F.length(digits).between(14, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def _found(text: Column, pattern: str, keep, make) -> Column:
    """Spans of all matches, placed by the lengths of the text between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    items = F.zip_with(
        F.split(text, pattern), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("len"), hit.alias("hit"))
    )
    items = F.filter(items, lambda x: x["hit"].isNotNull())
    every = placed(items, lambda x: x["gap"] + x["len"])
    return F.transform(
        F.filter(every, lambda x: keep(x["item"]["hit"])),
        lambda x: make(x["at"] + x["item"]["gap"], x["at"] + x["item"]["gap"] + x["item"]["len"], x["item"]["hit"]),
    )


def base_spans(text: Column) -> Column:
    """Sorted spans of the four kinds in one text."""
    each = []
    for rank, kind in enumerate(KINDS):
        def make(begin: Column, end: Column, hit: Column, rank: int = rank, kind: str = kind) -> Column:
            return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("value"))

        spans = _found(text, PATTERNS[kind], lambda v, kind=kind: _valid(kind, v), make)
        each.append(F.when(_may_hold(kind, text), spans).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return F.array_sort(F.concat(*each))


def rewritten(text: Column, spans: Column, put) -> Column:
    """The text with each of the sorted spans replaced by ``put(span, length)``;
    of spans that overlap, the later gives way where it is already covered.

    Spans are taken in blocks, each with its own cut of the text, so the work
    doesn't grow with the product of spans and length."""

    def in_cut(cut: Column, start: Column, block: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            begin, end = F.greatest(s["start"] - start, acc["at"]), s["end"] - start
            new = F.concat(acc["out"], F.substring(cut, acc["at"] + 1, begin - acc["at"]), put(s, end - begin))
            more = end > acc["at"]
            return F.struct(F.when(more, end).otherwise(acc["at"]).alias("at"), F.when(more, new).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def of_block(acc: Column, block: Column) -> Column:
        start = acc["at"]
        end = F.greatest(start, F.array_max(F.transform(block, lambda s: s["end"])))
        made = bound(F.substring(text, start + 1, end - start), lambda cut: in_cut(cut, start, block))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(in_blocks(spans), none, of_block, rest)


def _word_key(word: Column) -> Column:
    """Terms are lower-cased words, known by a 64-bit hash."""
    return F.xxhash64(F.lower(word))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _word_key))


def _blanked(text: Column, base: Column) -> Column:
    """The text with its base spans blanked out."""
    return F.when(F.size(base) > 0, rewritten(text, base, lambda s, n: F.repeat(F.lit(" "), n))).otherwise(text)


def _levels(span: Column) -> Column:
    """The entities a value stands for: itself, its group (email domain, first
    half of an ip, card issuer, start of a phone number) and its kind."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    group = (
        F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    )
    return F.array(F.concat(kind, F.lit(":"), value), F.concat(kind, F.lit(" group:"), group), F.concat(kind, F.lit(" any")))


def _searched(docs: DataFrame, *more: str) -> DataFrame:
    """th (a hash of the text), base, and the text of those that have a base span, by row."""
    rows = docs.select(*more, text_or_empty().alias("_rs_text")).withColumn("base", base_spans(F.col("_rs_text")))
    return rows.select(*more, F.xxhash64("_rs_text").alias("th"), "base", F.when(F.size("base") > 0, F.col("_rs_text")).alias("held"))


def _held(searched: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(th, copies, base, blanked, entities) of each different text with a base
    span, and (entity, df_entity) of the entities of at least ``support`` of them."""
    held = searched.where("held is not null")
    keys = F.array_distinct(F.flatten(F.transform("base", _levels)))
    # a row for each value and text: small beside the texts
    by_text = checkpointed(held.select("th", F.explode(keys).alias("entity")).groupBy("entity", "th").agg(F.count("*").alias("copies")))
    # written out: a join on a value that a third of all texts hold can then be split
    frequent = by_text.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("df_entity")).where(F.col("texts") >= support)
    frequent = checkpointed(frequent.select("entity", "df_entity"))
    of_text = by_text.join(frequent, "entity", "left_semi").groupBy("th").agg(F.collect_list("entity").alias("entities"))
    texts = held.groupBy("th").agg(F.count("*").alias("copies"), F.first("base").alias("base"), F.first("held").alias("text"))
    texts = texts.select("th", "copies", "base", _blanked(F.col("text"), F.col("base")).alias("blanked"))
    return checkpointed(texts.join(of_text, "th")), frequent


def _disclosing(docs: DataFrame, held: DataFrame, frequent: DataFrame, support: int, generalise_at: float, remove_at: float) -> DataFrame:
    """entity, term, remove: the terms (by hash) that give an entity away."""
    both = held.select("copies", "entities", F.explode(_terms(F.col("blanked"))).alias("term")).select("copies", "term", F.explode("entities").alias("entity"))
    met = both.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("met")).where(F.col("texts") >= support)
    met = checkpointed(met.select("entity", "term", "met"))
    text = text_or_empty()
    words = docs.select(F.explode(_terms(bound(text, lambda t: _blanked(t, base_spans(t))))).alias("term"))
    df = words.groupBy("term").agg(F.count("*").alias("df_term")).join(met.select("term").distinct(), "term", "left_semi")
    n = F.lit(float(docs.count()))
    pmi = F.log2(F.col("met") * n / (F.col("df_term") * F.col("df_entity")))
    told = F.try_divide(pmi, F.log2(n / F.col("df_entity")))
    measured = met.join(df, "term").join(frequent, "entity").withColumn("told", told).where(F.col("told") >= generalise_at)
    return checkpointed(measured.select("entity", "term", (F.col("told") >= remove_at).alias("remove")))


def _term_spans(text: Column, terms: Column) -> Column:
    names = F.transform(terms, lambda t: t["term"])
    removed = F.transform(F.filter(terms, lambda t: t["remove"]), lambda t: t["term"])

    def make(begin: Column, end: Column, hit: Column) -> Column:
        value = F.when(F.array_contains(removed, _word_key(hit)), F.lit("")).when(hit.rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))
        return F.struct(begin.alias("start"), F.lit(len(KINDS)).alias("rank"), end.alias("end"), F.lit(TERM).alias("kind"), value.alias("value"))

    return _found(text, WORD, lambda v: F.array_contains(names, _word_key(v)), make)


def _spans_of(docs: DataFrame, searched: DataFrame, support: int, generalise_at: float, remove_at: float) -> DataFrame:
    held, frequent = _held(searched, support)
    told = _disclosing(docs, held, frequent, support, generalise_at, remove_at)
    words = held.select("th", "entities", F.explode(_terms(F.col("blanked"))).alias("term"))
    # few terms tell anything: the rest goes before entities are looked at
    words = words.join(told.select("term").distinct(), "term", "left_semi").select("th", "term", F.explode("entities").alias("entity"))
    found = words.join(told, ["entity", "term"]).groupBy("th", "term").agg(F.max("remove").alias("remove"))
    terms = found.groupBy("th").agg(F.collect_list(F.struct("term", "remove")).alias("terms"))
    return checkpointed(held.join(terms, "th").select("th", _term_spans(F.col("blanked"), F.col("terms")).alias("more")))


def term_spans(docs: DataFrame, support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """th and the spans of its disclosing terms, one row a text that has any."""
    return _spans_of(docs, _searched(docs), support, generalise_at, remove_at)


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """Counts by kind and the listed spans of every whole text."""
    searched = checkpointed(_searched(docs, "doc_id"))
    more = _spans_of(docs, searched, support, generalise_at, remove_at).withColumnRenamed("th", "_th")
    rows = searched.select("doc_id", "th", "base").join(more, F.col("th") == F.col("_th"), "left")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """The documents with base spans replaced by their kind, and disclosing
    terms generalised or removed. Only documents with a base span are shuffled."""
    more = term_spans(docs, **how).withColumnRenamed("th", "_rs_th").withColumnRenamed("more", "_rs_more")
    text = text_or_empty()
    rows = docs.withColumn("_rs_base", base_spans(text))
    clean = rows.where(F.size("_rs_base") == 0).select(*docs.columns)
    held = rows.where(F.size("_rs_base") > 0)
    held = held.join(more, F.xxhash64(held["text"]) == more["_rs_th"], "left")
    spans = F.array_sort(F.concat("_rs_base", F.coalesce("_rs_more", F.array().cast(f"array<{_SPAN}>"))))
    new = rewritten(F.col("text"), spans, lambda s, n: F.when(s["kind"] == TERM, s["value"]).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    return clean.unionByName(held.withColumn("text", new).select(*docs.columns))
