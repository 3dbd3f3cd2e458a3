"""Every registered query against its SQL on the smallest tables; those without SQL must run and have rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from echoline import catalogue

DATA = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    rows = [tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.01").count()
        return
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
