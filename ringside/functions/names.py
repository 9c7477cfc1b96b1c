"""Canonical names: what two spellings of one name have in common."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Combining marks, name suffixes, and what isn't a letter, digit or space. Fixed patterns.
_MARKS = re.compile("[\u0300-\u036f]")
_SUFFIX = re.compile(r"\b(?:jr\.?|sr\.?|ii|iii|iv|v)\s*$", re.IGNORECASE)
_OTHER = re.compile(r"[^\w\s]|_")
_SPACE = re.compile(r"\s+")


def canonical(name: str | None) -> str | None:
    if name is None:
        return None
    plain = _MARKS.sub("", unicodedata.normalize("NFD", name)).lower()
    return _SPACE.sub(" ", _OTHER.sub("", _SUFFIX.sub("", plain))).strip()


def _canonical(names: pd.Series) -> pd.Series:
    return names.map(canonical, na_action="ignore")


def normalize_name(name: Column) -> Column:
    """Arrow batches: Spark has no Unicode decomposition of its own."""
    return F.pandas_udf(_canonical, T.StringType())(name)
