"""Every query that has SQL, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from labelgrid.plans import catalogue

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf, con, name):
    found = catalogue.queries()[name](spark, sf)
    cols = sorted(found.columns)
    rel = con.sql(catalogue.oracle_sql()[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    assert {c: TYPES[t] for c, t in found.dtypes} == dict(zip(names, map(str, rel.types)))
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in found.collect())
    place = [names.index(c) for c in cols]
    assert mine == sorted(repr(tuple(r[i] for i in place)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0
