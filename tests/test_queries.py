"""Every query over the job relations against its SQL on DuckDB: columns, types and values."""

import duckdb
import pytest

from tasklens.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "orders customer lineitem events supplier part".split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
#: Those without SQL: the bounds that their number of rows must keep.
ROWS_ONLY = {"st27_faulted": 1, "st22_local_limiter": 1000, "st23_shared_limiter": 1000, "fn04_jittered": 2000, "fn18_monotone_ids": 1600, "fn19_failing": 5000, "sc11_table_sizes": 2, "ag36_workload_digest": 1, "sm02_leases": 1, "sm06_first_while_active": 1}


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(value(r[k]) for k in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF)
    cursor = duck.execute(core.SQL[name])
    columns, found = [c[0] for c in cursor.description], cursor.fetchall()
    kinds = {c[0]: str(c[1]) for c in cursor.description if str(c[1]) != '"NULL"'}
    assert sorted(got.columns) == sorted(columns) and {k: TYPES[t] for k, t in got.dtypes if k in kinds} == kinds
    assert rows(got.columns, got.collect()) == rows(columns, found) and found


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql(spark, name):
    assert core.QUERIES[name](spark, SF).count() >= ROWS_ONLY[name]
