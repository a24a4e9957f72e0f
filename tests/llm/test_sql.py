"""Queries with SQL of their own against it, on the smallest tables."""

import duckdb
import pytest

from meshloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    found = queries.QUERIES[name](spark, small)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
