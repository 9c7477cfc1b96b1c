"""Base spans against a plain search, disclosing terms, rewriting."""

from __future__ import annotations

import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringside.llm import pii

# The base patterns as the contract states them. Fixed values.
PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def plain(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if holds(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, base string")


TEXTS = [
    None, "", "a@b.c_x@y.z", "é🎉 me@mail.example.com, x", "1.2.3.4.5 999.1.1.1 01.2.3.004", "4111 1111 1111 1111", "card 4111-1111-1111-1112", "+1 (555) 123-4567 end", "+49 30 1234567890123456",
    "x" * 50_000, "1" * 30_000, "a@" * 5_000, "4111 1111 1111 1111 " * 30, "+1.2.3.4 me@1.2.3.4", "@ . + 1", "a.b%c+d-e@x-y.z.w. next", "0.0.0.0" * 3, "00000000000000",
]


def check(spark, texts):
    for r in pii.digests(docs(spark, texts)).collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:80]
        kinds = [x.split(":")[0] for x in want.split(",") if x]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k, _ in PLAIN]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == want


def test_base_spans(spark):
    check(spark, TEXTS)


def test_base_spans_of_random_texts(spark):
    texts: list[str] = []

    @given(st.text(alphabet="a1@.+- ()4é\n", max_size=60))
    @settings(max_examples=150, deadline=None)
    def collect(t):
        texts.append(t)

    collect()
    check(spark, texts)


def group(n, extra=""):
    """n different texts in which 'quux' goes with one address, and 'common' is everywhere."""
    return [f"report{i} common quux boss@corp.example.com {extra} filler{i}" for i in range(n)]


def test_terms_that_give_an_entity_away(spark):
    texts = [*group(4), *[f"plain{i} common words here" for i in range(30)], "quux alone"]
    rows = {r.doc_id: r for r in pii.digests(docs(spark, texts)).collect()}
    shown = [[texts[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in rows[i].spans.split(",") if x) if k == "term"] for i in range(len(texts))]
    assert all(s == ["quux"] for s in shown[:4])  # told: log2(35 * 4 / (5 * 4)) / log2(35 / 4) = 0.9
    assert not any(shown[4:])  # clean documents are left alone
    out = {r.doc_id: r.text for r in pii.sanitised(docs(spark, texts)).collect()}
    assert out[0] == "report0 common [WORD] [EMAIL]  filler0" and out[4] == texts[4] and out[34] == "quux alone"


def test_removal_support_and_copies(spark):
    only = [*group(4), *[f"plain{i} common" for i in range(30)]]
    out = {r.doc_id: r.text for r in pii.sanitised(docs(spark, only)).collect()}
    assert out[1] == "report1 common  [EMAIL]  filler1"
    few = [*group(2), *[f"plain{i} common" for i in range(30)]]
    assert "term" not in "".join(r.spans for r in pii.digests(docs(spark, few)).collect())
    copies = [group(1)[0]] * 50 + [f"plain{i} common" for i in range(60)]  # one text, however often, supports nothing
    assert "term" not in "".join(r.spans for r in pii.digests(docs(spark, copies)).collect())


def test_rewriting_keeps_columns_and_nulls(spark):
    df = docs(spark, [None, "mail a@b.co now 1.2.3.4", "fine"]).withColumn("_th", F.lit(1))
    got = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert got[0].text is None and got[1].text == "mail [EMAIL] now [IP]" and got[2].text == "fine"
    assert set(got[1].asDict()) == {"doc_id", "text", "base", "_th"} and got[1].base == "e"
    assert pii.digests(df.limit(0)).count() == 0 and pii.sanitised(df.limit(0)).count() == 0


def shown_terms(spark, texts):
    rows = {r.doc_id: r.spans for r in pii.digests(docs(spark, texts)).collect()}
    return [[texts[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in rows[i].split(",") if x) if k == "term"] for i in range(len(texts))]


def test_rare_values_are_measured_by_group_and_kind(spark):
    """Every value in one text only: their domain or kind gives the terms."""
    plain_texts = [f"plain{i} common words here" for i in range(60)]
    domain = [f"report{i} common quux p{i}@corp.example.com" for i in range(4)]
    kind = [f"call{i} common zork {10 + i}.{20 + i}.3.4" for i in range(4)]
    shown = shown_terms(spark, [*domain, *kind, *plain_texts])
    assert all(s == ["quux"] for s in shown[:4]) and all(s == ["zork"] for s in shown[4:8]) and not any(shown[8:])


def test_short_words_are_terms(spark):
    texts = [*[f"report{i} common ab p{i}@corp.example.com" for i in range(4)], *[f"plain{i} common" for i in range(40)]]
    assert all(s == ["ab"] for s in shown_terms(spark, texts)[:4])


def entities(kind, value):
    digits = re.sub("[^0-9]", "", value)
    group = {"email": value.lower().split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
    return {f"{kind}:{value.lower()}", f"{kind} group:{group}", f"{kind} any"}


def plain_search(texts, support=3, generalise_at=0.8, remove_at=0.999):
    """All spans of each text (start, rank, end, kind, replacement) by plain counting over documents."""
    base = [sorted((m.start(), i, m.end(), k, f"[{k.upper()}]") for i, (k, p) in enumerate(PLAIN) for m in re.finditer(p, t or "") if holds(k, m.group())) for t in texts]
    held, words = [], []
    for t, spans in zip(texts, base, strict=True):
        blank = list(t or "")
        for a, _, b, *_ in spans:
            blank[a:b] = " " * (b - a)
        held.append(set().union(*(entities(k, t[a:b]) for a, _, b, k, _ in spans)))
        words.append([(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", "".join(blank))])
    n, df, entity, met, where = len(texts), {}, {}, {}, {}
    for t, es, ws in zip(texts, held, words, strict=True):
        for w in {w for _, _, w in ws}:
            df[w] = df.get(w, 0) + 1
            for e in es:
                met[e, w] = met.get((e, w), 0) + 1
                where.setdefault((e, w), set()).add(t)
        for e in es:
            entity[e] = entity.get(e, 0) + 1
            where.setdefault(e, set()).add(t)
    told = {}
    for (e, w), m in met.items():
        if len(where[e]) >= support and len(where[e, w]) >= support and entity[e] < n:
            share = math.log2(m * n / (df[w] * entity[e])) / math.log2(n / entity[e])
            if share >= generalise_at:
                told[e, w] = share >= remove_at
    out = []
    for spans, es, ws in zip(base, held, words, strict=True):
        more = []
        for a, b, w in ws:
            if found := [told[e, w] for e in es if (e, w) in told]:
                more.append((a, 9, b, "term", "" if any(found) else "[NUMBER]" if re.fullmatch("[0-9]+", w) else "[WORD]"))
        out.append(sorted(spans + more))
    return out


def plain_spans(texts):
    return [",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans) for spans in plain_search(texts)]


def plain_rewritten(text, spans):
    """Later spans give way where they are covered already."""
    out, at = [], 0
    for a, _, b, _, new in spans:
        if b > at:
            out += [text[at : max(a, at)], new]
            at = b
    return "".join(out) + text[at:]


def test_all_spans_against_plain_counting(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    values = ["p{}@a.example", "q{}@b.example", "10.1.{}.4", "+49 30 12345{:03d}"]
    texts = [None, "", None]
    for i in range(400):
        body = rng.choices(words, k=rng.randint(1, 12))
        if rng.random() < 0.25:
            kind = rng.randrange(4)
            body.insert(rng.randrange(len(body) + 1), values[kind].format(rng.randrange(200)))
            body += [f"tell{kind}"] * rng.randint(0, 2)
        texts.append(" ".join(body))
    texts += texts[5:40] * 2  # copies
    texts.append(" ".join(f"m{i}@long.example tell0 x{i % 7}" for i in range(4000)))  # very long, with many spans
    want = plain_spans(texts)
    got = {r.doc_id: r.spans for r in pii.digests(docs(spark, texts)).collect()}
    assert sum("term" in s for s in want) > 30
    assert [got[i] for i in range(len(texts))] == want
    out = {r.doc_id: r.text for r in pii.sanitised(docs(spark, texts)).collect()}
    assert all(out[i] == (t if t is None else plain_rewritten(t, spans)) for i, (t, spans) in enumerate(zip(texts, plain_search(texts), strict=True)))
