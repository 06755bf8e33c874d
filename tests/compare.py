"""Run named queries beside their SQL in DuckDB and compare rows and values.

``python -m tests.compare [folder] [name …]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import tempfile
import time

import duckdb

from deedscope.workload import ORACLE_SQL, QUERIES
from deedscope.workload.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else (False, "", str(v)) for v in row)


def mismatch(spark, con, name: str, sf_dir: str) -> str | None:
    """Why the query and its SQL differ, or None."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=_key)
    if name not in ORACLE_SQL:
        return None if got else "no rows"
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {list(set(got) ^ set(want))[:4]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(columns, a))} against {dict(zip(columns, b))}"
    if got and [type(v) for v in got[0]] != [type(v) for v in want[0]]:
        return f"types {[type(v) for v in got[0]]} against {[type(v) for v in want[0]]}"
    return None if got else "no rows"


def main() -> int:
    from deedscope.session import build_session

    spark = build_session(
        "compare", master="local[8]", shuffle_partitions=8, checkpoint_dir=tempfile.mkdtemp(prefix="compare-"),
        conf={"spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    con = duck(sf_dir)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            reason = mismatch(spark, con, name, sf_dir)
        except Exception as error:  # report it and go on with the next query
            reason = f"{type(error).__name__}: {str(error)[:600]}"
        bad += reason is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if reason is None else 'BAD ' + reason}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
