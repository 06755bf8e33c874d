"""Every named query against its SQL, and the shape of the driver contract."""

import pytest

import __spark_entry__ as driver
from deedscope.workload import ORACLE_SQL, QUERIES
from tests.compare import duck, mismatch
from tests.conftest import SF

@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert mismatch(spark, con, name, SF) is None


# How DuckDB names the Spark types the queries return.
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_types(spark, con, name):
    want = {row[0]: row[1] for row in con.execute(f"DESCRIBE {ORACLE_SQL[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in QUERIES[name](spark, SF).dtypes} == want


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert QUERIES.keys() <= driver.queries().keys()
    assert ORACLE_SQL.items() <= driver.oracle_sql().items()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and abs(sum(r["percentage_share"] for r in rows) - 100) < 0.1
