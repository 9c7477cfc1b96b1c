"""Scalar parsers of stat cells, as Spark columns.

White space is Unicode white space; digits are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CM_PER_INCH, KG_PER_LB = 2.54, 0.45359237


def clean(x: Column) -> Column:
    """White space collapsed and stripped."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def to_int(x: Column) -> Column:
    """The digits as a whole number; 0 where there is none."""
    return F.coalesce(F.regexp_replace(x, "[^0-9]", "").try_cast("int"), F.lit(0))


def landed_attempted(x: Column) -> Column:
    """struct(landed, attempted) of "X of Y"; zeros otherwise."""
    part = lambda i: F.coalesce(F.regexp_extract(x, r"(\d+)(?U:\s+)of(?U:\s+)(\d+)", i).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("landed"), part(2).alias("attempted"))


def control_seconds(x: Column) -> Column:
    """Seconds of "M:SS"; null otherwise."""
    part = lambda i: F.regexp_extract(clean(x), r"^(\d+):(\d{2})$", i).try_cast("int")
    return part(1) * 60 + part(2)


def _rounded(value: Column) -> Column:
    return F.bround(value, 1)


def height_cm(x: Column) -> Column:
    part = lambda i: F.regexp_extract(x, r"(\d+)'(?U:\s*)(\d+)", i).try_cast("int")
    return _rounded((part(1) * 12 + part(2)) * F.lit(CM_PER_INCH))


def reach_cm(x: Column) -> Column:
    return _rounded(F.regexp_extract(x, r"(\d+)", 1).try_cast("int") * F.lit(CM_PER_INCH))


def weight_kg(x: Column) -> Column:
    return _rounded(F.regexp_extract(x, r"(\d+)", 1).try_cast("int") * F.lit(KG_PER_LB))


def long_date(x: Column) -> Column:
    """"July 4, 2020"; null where it isn't a date."""
    return F.try_to_timestamp(clean(x), F.lit("MMMM d, yyyy")).cast("date")


def short_date(x: Column) -> Column:
    """"Jul 4, 2020"."""
    return F.try_to_timestamp(clean(x), F.lit("MMM d, yyyy")).cast("date")


def label_values(items: Column) -> Column:
    """Map of "label: value" texts; blanks and "--" are left out, the last of a
    label counts."""
    parts = F.transform(F.filter(items, lambda t: F.contains(t, F.lit(":"))), lambda t: F.split(clean(t), ":", 2))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["v"] != "") & (p["v"] != "--"))
    return F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )
