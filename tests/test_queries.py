"""Every registered query of the library against its SQL in DuckDB, on the smallest given tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from kbspark.plans import registered

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registered()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "~"
    if hasattr(x, "item") and not hasattr(x, "__len__"):
        x = x.item()
    return str(round(x, 6) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    return sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


