"""URL verdicts: explicit rules first, a tree of path templates for the rest.

Rules: a rule is host and path; it fits its host and all subdomains, where the
url's path starts with the rule's; the longest fitting rule decides.

Templates: the urls that rules decide are the labelled ones. For each host the
paths make a tree. From the root on, level by level until no path is left,
- segments that vary by their form (numbers, hex, dates) become wildcards;
- where a node has ``min_children`` different children or more, and at least
  every second page a new one, its children become one wildcard;
- sibling branches alike in statistics (the same most frequent continuation and
  the same fifth of the smoothed block rate) are merged.
A node's purity is (blocked + strength * purity of its parent) / (labelled +
strength), from the host's root down; above the root stands the block rate of all
labelled pages. So a template with few or no labelled pages of its own goes by its
branch, and that by its host. A template is rejected (verdict block) where its
purity is over ``purity``.

The tree is held as rows (host, path, counts), aggregated before any shuffle by
host, so one host with a third of all pages is a matter of its different paths;
nothing is gathered by host, and of a template's ancestors only their counts.

Defined results: a null url or one without ``://`` has empty host and path, and
verdict allow unless the purity of all such urls says otherwise; repeated rows
give repeated results; extra columns are ignored; an empty table gives an empty
result. Very long urls are taken whole: there are as many rounds as levels at
which two different paths of a host still go together. Ties: of continuations equally frequent
the greater by code point counts; a purity of just ``purity`` isn't rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: The rules of the production query. Fixed values.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> Column:
    """struct(host, path)."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return F.struct(F.when(has, host).otherwise("").alias("host"), F.when(has, path).otherwise("").alias("path"))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, at, rule, verdict) of the longest fitting rule, or null."""
    fits = []
    for at, (verdict, rule) in enumerate(rules):
        h, slash, p = rule.partition("/")
        fit = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(-at).alias("at"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def form_of(segment: Column) -> Column:
    """A segment, or a wildcard for segments that vary by their form."""
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.lit("{number}"))
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), F.lit("{date}"))
        .when(segment.rlike(r"^[0-9A-Fa-f-]{16,}$"), F.lit("{hex}"))
        .otherwise(segment)
    )


def templates(paths: DataFrame, min_children: int = 8, purity: float = 0.5, strength: float = 2.0) -> DataFrame:
    """host, first (the path by form) -> template, rejected.

    ``paths``: host, first, n, labelled, blocked; one row for each host and first.
    """
    paths = checkpointed(paths)  # from here on as many rows as different paths
    whole = paths.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("n")).first()
    size = whole["n"]
    prior = (whole["b"] or 0) / whole["l"] if whole["l"] else 0.0
    smooth = lambda b, l, above: (b + F.lit(strength) * above) / (l + F.lit(strength))  # noqa: E731, E741
    rows, done = paths.withColumn("left", F.split("first", "/")).withColumn("made", F.lit("")), []
    while True:
        step = rows.withColumn("seg", F.get("left", F.lit(0))).withColumn("left", F.slice("left", 2, 1 << 30)).withColumn("then", F.array_join("left", "/"))
        # a child's most frequent continuation: counts first, so that no node is gathered
        conts = step.groupBy("host", "made", "seg", "then").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("paths"))
        children = conts.groupBy("host", "made", "seg").agg(
            F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.sum("paths").alias("paths"), F.max(F.struct("n", "then")).alias("most")
        )
        children = checkpointed(children.withColumn("rate", F.floor(smooth(F.col("b"), F.col("l"), F.lit(prior)) * 5)), size)
        nodes = children.groupBy("host", "made").agg(F.count("*").alias("kinds"), F.sum("n").alias("pages"), F.sum("paths").alias("paths"))
        varies = (F.col("kinds") >= min_children) & (F.col("kinds") * 2 >= F.col("pages"))
        alike = children.groupBy("host", "made", F.col("most.then").alias("then"), "rate").agg(F.min("seg").alias("least"), F.count("*").alias("members"))
        named = (
            children.withColumn("then", F.col("most.then")).join(nodes.select("host", "made", varies.alias("varies"), (F.col("paths") == 1).alias("alone")), ["host", "made"])
            .join(alike, ["host", "made", "then", "rate"])
            .select("host", "made", "seg", "alone", F.when(F.col("seg") == "", "").when(F.col("varies"), "{any}")
                    .when((F.col("members") > 1) & ~F.startswith("seg", F.lit("{")), F.concat(F.lit("{"), "least", F.lit("|"), F.col("members").cast("string"), F.lit("}")))
                    .otherwise(F.col("seg")).alias("name"))
        )
        # the only path of a node has no siblings further down: the rest of it stays as it is
        ends, none = F.col("alone") & (F.size("left") > 0), F.array().cast("array<string>")
        made = F.concat("made", F.lit("/"), "name", F.when(ends, F.concat(F.lit("/"), "then")).otherwise(""))
        rows = step.join(named, ["host", "made", "seg"]).withColumn("made", made).withColumn("left", F.when(ends, none).otherwise(F.col("left")))
        rows = checkpointed(rows.select(*paths.columns, "left", "made"), size)
        done.append(rows.where(F.size("left") == 0))
        rows = rows.where(F.size("left") > 0)
        size = rows.count()
        if not size:
            break
    rows = reduce(DataFrame.union, done).select("host", "first", "labelled", "blocked", F.col("made").alias("template"))
    parts = F.split("template", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))  # the host's root is ""
    sums = rows.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    ways = checkpointed(sums.select("host", "template", "l", "b", F.posexplode(above).alias("depth", "node")), whole["n"])
    nodes = checkpointed(ways.groupBy("host", "node").agg(F.sum("l").alias("l"), F.sum("b").alias("b")), whole["n"])
    of_way = ways.drop("l", "b").join(nodes, ["host", "node"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "l", "b"))).alias("way"))
    pure = F.aggregate("way", F.lit(float(prior)), lambda p, x: smooth(x["b"], x["l"], p))
    rejected = of_way.select("host", "template", (pure > purity).alias("rejected"))
    # written out, so that the join of all pages with a hot template can be split
    return checkpointed(rows.select("host", "first", "template").join(rejected, ["host", "template"]), whole["n"])


def judged(pages: DataFrame, rules=RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every url."""
    rows = pages.select("page_id", parsed(F.col("url")).alias("u")).select("page_id", "u.host", "u.path")
    rows = rows.withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    first = F.array_join(F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), form_of), "/")
    rows = rows.withColumn("first", first)
    labelled = F.col("r").isNotNull().cast("long")
    blocked = F.coalesce(F.col("r.verdict") == "block", F.lit(False)).cast("long")
    paths = rows.groupBy("host", "first").agg(F.count("*").alias("n"), F.sum(labelled).alias("labelled"), F.sum(blocked).alias("blocked"))
    tree = templates(paths, **how)
    return rows.join(tree, ["host", "first"], "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.coalesce(F.col("rejected"), F.lit(False)), "block").otherwise("allow")).alias("verdict"), "template",
    )
