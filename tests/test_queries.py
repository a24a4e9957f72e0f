"""Every query against its SQL in DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from meshloom.plans.registry import ORACLE_SQL, QUERIES
from meshloom.plans.views import TABLES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def shown(value):
    if value is None:
        return (0, "")
    return (1, f"{float(value):.9g}" if isinstance(value, float | decimal.Decimal) else str(value))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    columns = sorted(found.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in found.collect())
    cursor = duck.execute(ORACLE_SQL[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(kinds) == columns
    assert {c: TYPES[k] for c, k in found.dtypes} == kinds
    at = [list(kinds).index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() > 0
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["workspace_flag", "label_to_node", "assign_prompt", "obj_relabel"])
def test_no_cross_join_of_tables(spark, small, name):
    """Only a library of prompts may be met by a range; everything else is an equality."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert name == "assign_prompt" or "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["metric_filter", "workspace_list", "chunk_plan"])
def test_columns_are_pruned(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("ReadSchema: struct<")[1:]]
    assert reads and not any("text:string" in r.split(">")[0] for r in reads)
