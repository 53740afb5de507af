"""Every query of the engine against its SQL."""

import glob
import os

import duckdb
import pytest

from rivulet.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, D)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*[f"`{c}`" for c in cols]).collect())) == sorted(map(key, want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
