"""Queries against their SQL, on whole small tables."""

import glob
import os

import duckdb
import pytest

from rivulet.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, D)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*cols).collect())) == sorted(map(key, want))
