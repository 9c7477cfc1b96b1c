"""Stat cells, dates, methods, names, pages and JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.names import normalize_name
from ..operators import report
from ..plans.bouts import FROM_SALES
from ..sources import markets
from .base import Registry, tables

_r = Registry()


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables(spark, sf_dir, name)[name]


def scalar_stat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as pages have them, made from parts, and read back."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pair = F.concat((k % 90).cast("string"), F.lit("  of "), (k % 90 + k % 7).cast("string"))
    pair = F.when(k % 11 == 0, "---").otherwise(pair)
    ctrl = F.when(k % 13 == 0, "--").otherwise(F.concat(F.lit(" "), (k % 5).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(" ")))
    height = F.when(k % 17 == 0, "--").otherwise(F.concat((5 + k % 2).cast("string"), F.lit("' "), (k % 12).cast("string"), F.lit('"')))
    both = cells.landed_attempted(pair)
    reach = F.when(k % 19 == 0, "--").otherwise(F.concat((60 + k % 25).cast("string"), F.lit('"')))
    items = F.array(F.concat(F.lit("Reach: "), reach), F.lit("no label"), F.concat(F.lit(" Stance : S"), (k % 3).cast("string"), F.lit(": x ")), F.lit("Weight: --"), F.lit("DOB:"))
    known = cells.label_values(items)
    return p.select(
        cells.reach_cm(reach).alias("reach_cm"), F.array_join(F.array_sort(F.map_keys(known)), ",").alias("labels"), known["Stance"].alias("stance"),
        "p_partkey", both["landed"].alias("landed"), both["attempted"].alias("attempted"), cells.control_seconds(ctrl).cast("double").alias("control_seconds"),
        cells.height_cm(height).alias("height_cm"), cells.weight_kg(F.concat((115 + k % 150).cast("string"), F.lit(" lbs."))).alias("weight_kg"),
        cells.to_int(F.concat(F.lit("-"), (k % 100).cast("string"))).alias("digits"), cells.clean(F.concat(F.lit("  "), F.col("p_name"), F.lit("\t\n x "))).alias("cleaned"),
    )


_r.add("scalar_stat_cells", scalar_stat_cells, r"""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey % 90 END::INT AS landed, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey % 90 + p_partkey % 7 END::INT AS attempted,
  CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 5 * 60 + p_partkey % 60)::DOUBLE END AS control_seconds,
  CASE WHEN p_partkey % 17 <> 0 THEN round_even(((5 + p_partkey % 2) * 12 + p_partkey % 12) * 2.54::DOUBLE, 1) END AS height_cm,
  CASE WHEN p_partkey % 19 <> 0 THEN round_even((60 + p_partkey % 25) * 2.54::DOUBLE, 1) END AS reach_cm, CASE WHEN p_partkey % 19 <> 0 THEN 'Reach,Stance' ELSE 'Stance' END AS labels,
  'S' || p_partkey % 3 || ': x' AS stance, round_even((115 + p_partkey % 150) * 0.45359237::DOUBLE, 1) AS weight_kg, (p_partkey % 100)::INT AS digits, trim(regexp_replace('  ' || p_name || chr(9) || chr(10) || ' x ', '\s+', ' ', 'g')) AS cleaned FROM part""")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    long = F.when(F.col("o_orderkey") % 9 == 0, "Smarch 13, 1995").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return o.select("o_orderkey", cells.long_date(long).cast("string").alias("day"), cells.short_date(F.date_format("o_orderdate", "MMM d, yyyy")).cast("string").alias("short_day"))


_r.add("dates", dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS short_day FROM orders")
_r.plan("method_class", FROM_SALES.then(("out", lambda d: """SELECT fight_url, method,
  CASE WHEN upper(method) LIKE '%KO%' AND upper(method) NOT LIKE '%COULD NOT%' THEN 'ko' WHEN upper(method) LIKE '%SUBMISSION%' THEN 'submission' WHEN upper(method) LIKE '%DECISION%' THEN 'decision' WHEN upper(method) LIKE '%DRAW%' THEN 'draw' ELSE 'other' END AS career_class,
  CASE WHEN lower(method) LIKE '%doctor''s stoppage%' OR lower(method) LIKE '%could not continue%' THEN 'injury' WHEN lower(method) LIKE '%dq%' OR lower(method) LIKE '%disqualification%' THEN 'dq' WHEN upper(method) LIKE '%KO%' THEN 'KO/TKO' WHEN upper(method) LIKE '%SUB%' THEN 'Submission' ELSE 'Decision' END AS elo_class,
  lower(method) LIKE '%nc%' OR lower(method) LIKE '%no contest%' AS glicko_skipped FROM bouts""".replace("''", "\\'" if d.name == "spark" else "''"))), "lineitem", "orders", "customer")


def name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", normalize_name(F.concat("text", F.lit("  O'Neil-Smith Jr."))).alias("name"))


_r.add("name_norm", name_norm, r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text || '  O''Neil-Smith Jr.')), '\b(?:jr\.?|sr\.?|ii|iii|iv|v)\s*$', ''), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS name FROM documents""")


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page in order, each once."""
    p = _t(spark, sf_dir, "pages")
    urls = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)))
    return p.select("page_id", F.size(urls).cast("long").alias("n_links"), F.array_join(urls, "|").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_r.add("html_links", html_links, """WITH l AS (SELECT page_id, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS u FROM pages), d AS (SELECT page_id, html, [x FOR x, i IN u IF list_position(u, x) = i] AS v FROM l)
SELECT page_id, len(v)::BIGINT AS n_links, array_to_string(v, '|') AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM d""")


def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with lists in strings, made from conversations, and read."""
    c = _t(spark, sf_dir, "conversations")
    cid = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    ids = F.when(F.col("conv_id") % 7 == 0, "not json").otherwise(F.concat(F.lit('[\\"y'), cid, F.lit('\\",\\"n'), cid, F.lit('\\"]')))
    flags = F.when(F.col("conv_id") % 5 == 0, '"active":true,"closed":true').when(F.col("conv_id") % 3 == 0, '"active":true').otherwise('"active":true,"closed":false')
    body = F.concat(F.lit('{"markets":[{"id":"'), cid, F.lit('","question":"q'), cid, F.lit('","clobTokenIds":"'), ids, F.lit('","outcomes":"[\\"Yes\\",\\"No\\"]",'), flags, F.lit("}]}"))
    return markets.market_rows(c.select(body.alias("payload"))).select("market_id", "question", "token_id", "outcome")


_r.add("json_explode", json_explode, """SELECT conv_id || '.' || turn AS market_id, 'q' || conv_id || '.' || turn AS question, x[1] || conv_id || '.' || turn AS token_id, x[2] AS outcome
FROM conversations, unnest([['y', 'Yes'], ['n', 'No']]) t(x) WHERE conv_id % 7 <> 0 AND conv_id % 5 <> 0 AND conv_id % 3 <> 0""")


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "labels")
    answer = F.concat(F.lit('{"verdict":"'), F.element_at(F.array(F.lit("CONFIRM"), F.lit("VETO"), F.lit("MAYBE")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit('","confidence":'), (F.col("doc_id") % 13 / 10).cast("string"), F.lit(',"evidence_urls":["u"]}'))
    answer = F.when(F.col("doc_id") % 17 == 0, "oops").otherwise(answer)
    rows = report.parsed_verdicts(d.select("doc_id", answer.alias("answer")))
    return rows.select("doc_id", F.when(F.col("error").isNull(), F.col("parsed.verdict")).alias("verdict"), "error")


_r.add("verdict_parse", verdict_parse, """SELECT doc_id, CASE WHEN e IS NULL THEN v END AS verdict, e AS error FROM (SELECT doc_id, v, CASE WHEN doc_id % 17 = 0 THEN 'not a verdict' WHEN v = 'MAYBE' THEN 'unknown verdict' WHEN doc_id % 13 > 10 THEN 'confidence outside 0..1' END AS e
FROM (SELECT doc_id, ['CONFIRM', 'VETO', 'MAYBE'][(doc_id % 3 + 1)::INT] AS v FROM labels) x) y""")

QUERIES, SQL = _r.queries, _r.sql
