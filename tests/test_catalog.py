"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from cartolith import catalog

catalog.load()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    out = duck.sql(catalog.ORACLES[name])
    assert sorted(out.columns) == order
    want = sorted((tuple(plain(r[out.columns.index(c)]) for c in order) for r in out.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() >= 1
