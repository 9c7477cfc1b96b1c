"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
LARGER = {"folds": "/root/testdata/sf0.01"}  # the smallest tables hold too few bouts for two folds
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    def over(data: str) -> duckdb.DuckDBPyConnection:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        return con

    return over


def rows(df: pd.DataFrame) -> list[tuple]:
    def shown(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    data = LARGER.get(name, DATA)
    got, want = entry.queries()[name](spark, data).toPandas(), duck(data).execute(SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_folds_refuse_too_few_bouts(spark, duck):
    with pytest.raises(ValueError, match="too few"):
        entry.queries()["folds"](spark, DATA)
    assert duck(DATA).execute(SQL["folds"]).fetchall() == []


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["fight_url", "side", "fighter", "fights", "wins", "losses", "win_pct"] and df.count() > 0
