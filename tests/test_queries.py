"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lzseq import catalogue

SF = "/root/testdata/sf0.001"
ENTRIES = catalogue.entries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, con, name):
    run, sql = ENTRIES[name]
    got = run(spark, SF).toPandas()
    if not sql:
        assert len(got)
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows(got), key=key) == sorted(rows(want), key=key)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return [tuple(None if pd.isna(v) else round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False)]


def test_entry_file_imports():
    import __spark_entry__

    assert set(ENTRIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
