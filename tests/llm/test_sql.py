"""The operators that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lzseq.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_follows_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(found.columns) == names
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, want.select(", ".join(f'"{n}"' for n in names)).fetchall()))
