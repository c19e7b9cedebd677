"""Every engine query against its oracle SQL on DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(v) -> str:
    if hasattr(v, "__len__") and not isinstance(v, str):
        return repr([text(x) for x in v])
    if v is None or pd.isna(v):
        return "null"
    return repr(float(v)) if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
