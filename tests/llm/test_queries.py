"""Queries with a DuckDB twin give the twin's rows."""

import os

import pytest

pytest.importorskip("public_tokenizers")
import duckdb

from tilewright.llm import queries

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got) > 0
    columns = sorted(want.columns)
    a, b = ([tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False)] for f in (want, got))
    assert sorted(a) == sorted(b)
