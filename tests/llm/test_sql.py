"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from labelgrid.llm import queries

SF = "/root/testdata/sf0.01"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, SF).select(*rel.columns)
    assert [TYPES[t] for _, t in found.dtypes] == list(map(str, rel.types))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rel.fetchall()))


def test_one_query_an_operator():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
