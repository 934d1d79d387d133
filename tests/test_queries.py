"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sieveworks.plans import catalog
from sieveworks.plans.proxies import TABLES

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    out = df[columns].copy()
    for c in columns:
        out[c] = out[c].map(plain)
    return out.sort_values(columns, na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in SQL:
        pd.testing.assert_frame_equal(normal(got), normal(duck.sql(SQL[name]).df()), check_dtype=False)
    else:
        assert len(got.columns)
