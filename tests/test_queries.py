"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from terravane.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def ordered(df):
    df = df[sorted(df.columns)]
    df = df.astype({c: "float64" for c in df.columns if str(df[c].dtype) in ("Int64", "Int32")})
    floats = [c for c in df.columns if pd.api.types.is_float_dtype(df[c])]
    first = [c for c in df.columns if c not in floats or df[c].isna().any()]
    return df.sort_values([*first, *(c for c in floats if c not in first)]).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
