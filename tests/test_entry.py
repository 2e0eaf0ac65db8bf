"""The registered queries of the engine against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from docloom import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_against_sql(spark, db, name):
    got = engine.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rel = db.execute(engine.SQL[name])
    at = [d[0] for d in rel.description]
    assert sorted(at) == names
    want = sorted((tuple(plain(r[at.index(n)]) for n in names) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
