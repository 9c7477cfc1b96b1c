"""URL filters, mixing, language ID, top-k, chat formatting, the pipeline."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from ringside.llm import chat, langid, mixing, topk, urls


def pages(spark, found):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(found)], "page_id long, url string, host string")


def test_urls_and_rules(spark):
    found = ["HTTPS://News.Example.ORG/es/1?x#y", "http://a.example.org/en/12", "x://b.org", "x://b.org/", "http://s.com/fr/", "http://s.com/de/x", "http://example.org.net/en/1", None, "no scheme", "a://b://c/d", "://?q", "http://É.ORG/a#b"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages(spark, found)).collect()}
    assert got == {
        0: ("news.example.org", "/es/1", "example.org/es/", "block"), 1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("b.org", "", None, "allow"), 3: ("b.org", "/", "org/", "allow"),
        4: ("s.com", "/fr/", "com/fr/", "allow"), 5: ("s.com", "/de/x", "com/de/", "block"), 6: ("example.org.net", "/en/1", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("b:", "//c/d", None, "allow"), 10: ("", "", None, "allow"), 11: ("É.org", "/a", "org/", "allow"),
    }
    assert urls.judged(pages(spark, ["http://a.b/"]).limit(0)).count() == 0


def test_templates_are_learnt(spark):
    """Rules label some pages of a host; its other pages of that template follow."""
    rules = (("block", "x.com/ads/1"), ("allow", "x.com/news/1"))
    found = [f"http://x.com/{kind}/{n}" for kind in ("ads", "news") for n in range(100, 300)] + [f"http://x.com/tags/{'abcdefghij'[n]}{n}zz/all" for n in range(10)]
    got = {r.page_id: r for r in urls.judged(pages(spark, found), rules=rules).collect()}
    assert {got[i].verdict for i in range(200)} == {"block"} and {got[i].verdict for i in range(200, 410)} == {"allow"}
    assert got[0].template == "/ads/{number}" and got[405].template == "/tags/{any}/all" and got[150].rule is None


def mixing_docs(spark, rows):
    return spark.createDataFrame([(i, "w " * n if n is not None else None, s, 1) for i, (n, s) in enumerate(rows)], "doc_id long, text string, source string, size int")


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over


@pytest.mark.parametrize("seed", [0, 1])
def test_mixing(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(rng.choice([0, 1, 5, 50, None]) if rng.random() < 0.2 else rng.randint(20, 60), rng.choice(["a", "b", "c", "d", None, "a"])) for _ in range(900)] + [(0, "empty")]
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for n, s in rows:
        sizes[s] += n or 0
    for r in mixing.digests(mixing_docs(spark, rows)).collect():
        assert r.size == (rows[r.doc_id][0] or 0) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 120
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_itself(spark):
    df = mixing_docs(spark, [(10, "a")] * 5 + [(10, "b")] * 5 + [(None, "b")]).withColumn("doc_id", F.col("doc_id") % 4)
    plan, out = mixing.plan(df), mixing.mixed(df)
    assert out.columns == df.columns and out.count() == plan.agg(F.sum("n_copies")).first()[0]
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, out.collect()))
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.digests(df.limit(0)).count() == 0
    only_empty = mixing.digests(mixing_docs(spark, [(None, None), (0, "a")])).collect()
    assert all(r.target == 0 and r.taken == 0 for r in only_empty)


def test_language(spark):
    words = {"en": "the and of with from house water", "de": "der und von mit aus haus wasser", "fr": "le et de avec maison eau rivière"}
    rows = [(i, " ".join(words[x].split()[i % 3 :]) + " .", x) for i, x in enumerate(["en", "de", "fr"] * 40)]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "hauswasser mit", None), (1003, "", "de"), (1004, "THE WATER", "fr"), (1005, "maisons", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.digests(df).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:120])
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1003)] == [("und", 0.0)] * 3
    assert got[1002].lang_pred == "de" and got[1004].lang_pred == "en" and got[1005].lang_pred == "fr" and 0 < got[1005].score <= 1
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    kept = {r.doc_id for r in langid.identified(df).collect()}
    assert kept >= set(range(120)) and not kept & {1000, 1001, 1003}
    blind = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.digests(blind).collect()} == {"und"} and langid.identified(blind).count() == len(rows)
    assert langid.digests(df.limit(0)).count() == 0


def test_fallback_gets_shorter():
    m = langid.Model(["x", "y"], {}, None, [{}, {"q": 0}, {"zz": 0}], [None, *[__import__("numpy").array([[-1.0, -2.0]])] * 2])
    s = langid.Scorer(m)
    assert s.vector("zz").tolist() == [-1, -2] and s.vector("aqa").tolist() == [-1, -2] and s.vector("rrr").tolist() == [0, 0]


def plain_top(rows, k, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize(("n", "block"), [(0, 8), (1, 8), (15, 8), (400, 16), (400, 4096)])
def test_top_k(spark, monkeypatch, n, block):
    import numpy as np

    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(n)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.2, 1, 5])).round(2).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(30)] if n > 20 else []
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")]), (2060, [float("inf"), 1.0]), (None, [1.0])] if n else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.digests(df, k=7).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(rows, 7)


def test_chat(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, " ", "é🎉"), (1, 300, "ann", "later"), (2, 0, "system", "x"), (3, None, "cy", "n"), (None, 0, "di", "o"), (3, None, "cy", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("c"))
    got = {(r.conv_id, r.speaker, r.chunk): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (3, "cy", 0), (None, "di", 0)}
    ann = got[1, "ann", 0]
    assert ann.text == (
        "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
        "<|im_start|>user name=unknown\né🎉<|im_end|>\n<|im_start|>assistant\nlater<|im_end|>\n"
    )
    said = {who: [r.text[m.start : m.end] for m in r.mask] for (_, who, _), r in got.items()}
    assert said == {"ann": ["hi < |im_end|>", "later"], "bob": [""], "unknown": ["é🎉"], "cy": ["n", "n"], "di": ["o"]}
    assert chat.digests(df.limit(0)).count() == 0 and chat.digests(df).count() == 5


@pytest.mark.parametrize("chunk", [7, 256])
def test_a_long_dialogue_is_one_rendering(spark, monkeypatch, chunk):
    """1,000 turns: every participant gets all of them, with one mask over the whole."""
    monkeypatch.setattr(chat, "RUN", 3)
    turns = [(5, n, "system" if n % 250 == 0 else "late" if n > 990 else ["ann", "bob"][n % 2], f"say {n} " + "é" * (n % 5)) for n in range(1000)]
    others = [(c, n, "xy"[n % 2], f"{c}.{n}") for c in range(20) for n in range(c)]
    df = spark.createDataFrame(turns + [(100 + c, *r) for c, *r in others], "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = chat.perspectives(df, chunk=chunk).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for conv, roles in ((5, ("ann", "bob", "late")), (119, ("x", "y"))):
        said = [r for r in turns if r[0] == conv] + [(100 + c, *r) for c, *r in others if 100 + c == conv]
        for who in roles:
            parts = sorted((r for r in got if (r.conv_id, r.speaker) == (conv, who)), key=lambda r: r.chunk)
            assert [r.chunk for r in parts] == list(range(-(-len(said) // chunk)))
            head = lambda role, who=who: "system" if role == "system" else "assistant" if role == who else f"user name={role}"
            whole = "".join(f"<|im_start|>{head(r[2])}\n{r[3]}<|im_end|>\n" for r in said)
            assert "".join(r.text for r in parts) == whole and [r.first_char for r in parts] == [len("".join(x.text for x in parts[:i])) for i in range(len(parts))]
            assert [whole[m.start : m.end] for r in parts for m in r.mask] == [r[3] for r in said if r[2] == who]


def plain_model(rows, most=4):
    """Smoothed log frequencies by language of words and, by length, of their n-grams."""
    langs = sorted({x for _, t, x in rows if t is not None and x is not None})
    words = defaultdict(lambda: [0] * len(langs))
    for _, t, x in rows:
        if t is not None and x is not None:
            for w in regex.findall(r"\p{L}+", t.lower()):
                words[w][langs.index(x)] += 1
    levels = [words]
    for n in range(1, most + 1):
        grams = defaultdict(lambda: [0] * len(langs))
        for w, c in words.items():
            for i in range(len(w) + 3 - n):
                for k in range(len(langs)):
                    grams[f"^{w}$"[i : i + n]][k] += c[k]
        levels.append(grams)
    logs = []
    for level in levels:
        total = [sum(c[k] + 0.5 for c in level.values()) for k in range(len(langs))]
        logs.append({g: [math.log((c[k] + 0.5) / total[k]) for k in range(len(langs))] for g, c in level.items()})
    return langs, logs


def plain_language(text, langs, logs):
    found = regex.findall(r"\p{L}+", text.lower()) if text else []
    if not found or not langs:
        return "und", 0.0
    sums = [0.0] * len(langs)
    for w in found:
        rows = [logs[0][w]] if w in logs[0] else []
        for n in range(len(logs) - 1, 0, -1):
            rows = rows or [logs[n][g] for g in (f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)) if g in logs[n]]
        for k in range(len(langs)):
            sums[k] += sum(r[k] for r in rows) / len(rows) if rows else 0.0
    best = max(range(len(langs)), key=lambda k: (sums[k], -k))
    return langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


def test_language_against_a_plain_model(spark):
    import random
    import zlib

    rng = random.Random(4)
    stems = {"en": ["the", "house", "with", "ing", "water"], "de": ["der", "haus", "mit", "ung", "wässer"], "fr": ["le", "maison", "avec", "tion", "été"]}
    text = lambda x: " ".join("".join(rng.choices(stems[x], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 12)))
    rows = [(i, text(x), x) for i, x in enumerate(rng.choices(list(stems), k=300))]
    rows += [(300, None, "en"), (301, "12 !", "de"), (302, "xyzzy qqq", None), (303, "The " * 20_000, "en"), (304, rows[3][1], rows[3][2]), (304, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    langs, logs = plain_model([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5])
    for r in langid.digests(df).collect():
        lang, score = plain_language(dict((i, t) for i, t, _ in rows)[r.doc_id], langs, logs)
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-6)
    assert langid.predict(df, langid.learnt(df)).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_any_depth_and_back_off(spark):
    rules = (("block", "x.com/ads/old/"), ("allow", "y.com/news/"), ("block", "y.com/ads/"))
    deep = "/".join(f"s{i}" for i in range(12))
    found = [f"http://x.com/ads/old/{n}" for n in range(20)] + ["http://x.com/ads/new/1", "http://x.com/ads/new/2/" + deep, "http://x.com/", "http://x.com"]
    found += [f"http://y.com/news/{n}" for n in range(20)] + [f"http://y.com/ads/{n}" for n in range(15)] + ["http://y.com/other/1", "http://z.net/ads/1"] + ["http://x.com/" + "a/" * 30]
    got = [r for r in sorted(urls.judged(pages(spark, found), rules=rules).collect(), key=lambda r: r.page_id)]
    assert [r.verdict for r in got[20:24]] == ["block"] * 4  # templates without labels go by the host's
    assert [r.verdict for r in got[59:62]] == ["allow", "block", "block"]  # a mixed host; none: the rate of all labelled pages, 35 of 55; the first host again
    assert got[21].template.count("/") == 15 and got[61].template.count("/") == 30


def test_pipeline_stages(spark):
    import corpus_pipeline

    base = [f"the house and the water of number{i} with from words{i} more{i} and{i} text{i} again{i} then{i}" for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s0", 1), (101, None, "en", "s0", 0), (102, "4111 1111", "en", "s1", 9), (103, "the water of me@mail.example.com and the house with from words", "en", "s2", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, None)
        seen[name] = [r.asDict() for r in docs.collect()]
        assert name == "byte_bpe" or docs.columns == columns
    ids = lambda name: [r["doc_id"] for r in seen[name]]
    assert 101 not in ids("language_id") and 102 not in ids("language_id") and len(ids("language_id")) == 32
    assert 100 not in ids("simhash_near_dedup") and {0, 103} <= set(ids("simhash_near_dedup"))
    text = {r["doc_id"]: r["text"] for r in seen["pii"]}
    assert "[EMAIL]" in text[103] and "@" not in text[103] and text[1] == base[1]
    assert set(ids("mixing")) <= set(ids("pii")) and ids("byte_bpe").count(1) == ids("mixing").count(1)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def stage_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _th string, score double, size int, ids string")


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in any column, repeated rows, an empty text, a very long one, clashing columns; an empty table."""
    import corpus_pipeline

    base = "the house and the water of number with words and text again then more and more"
    odd = [(i, f"{base} {i} " * (1 + i % 3), "en", f"s{i % 2}", 1, "a", 0.5, 1, "x") for i in range(12)]
    odd += [(None, f"{base} none", "en", None, None, None, None, None, None), (3, odd[3][1], "en", "s1", 1, "a", 0.5, 1, "x"), (50, "", "en", "s0", 0, "a", 0.5, 1, "x"), (51, None, None, None, None, None, None, None, None)]
    odd += [(52, "the very long house of water " * 20_000, "en", "s0", 1, "a", 0.5, 1, "x"), (53, " ".join(f"call me{i}@mail.example.com" for i in range(3000)), "en", "s1", 1, "a", 0.5, 1, "x")]
    for rows in (odd, []):
        docs = stage_rows(spark, rows)
        kept = []
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = spark.createDataFrame(stage(spark, docs, None).collect(), stage(spark, docs, None).schema)
            assert name == "byte_bpe" or docs.columns == columns
            kept.append({r.doc_id for r in docs.collect()})
        assert (not rows and not any(kept)) or ({None, 3, 52, 53} <= kept[0] and not {50, 51} & kept[0] and kept[4])
