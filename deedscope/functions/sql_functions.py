"""The row functions offered to SQL users, as built-in expressions instead of Python UDFs.

``register_sql_functions`` declares the deterministic ones as temporary SQL functions, which
the analyser expands in place, so queries that call them keep whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from deedscope.functions.scalars import _c, _let


def timestamp_text(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def substring_between(word: Column | str, start: int, end: int) -> Column:
    """Characters ``start`` to ``end``, counted from one, both included."""
    return F.substring(_c(word), start, max(end - start + 1, 0))


def stddev_of_array(values: Column | str) -> Column:
    """Population standard deviation of an array's elements."""
    v = _c(values)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
    squares = _let(
        mean, lambda m: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    )
    return F.sqrt(squares / n)


def random_text(length: Column | int, seed: int) -> Column:
    return F.randstr(length, seed)


def clustered(x: Column | str, rows: int) -> Column:
    return F.floor(_c(x) - 1) / F.lit(float(rows))


def clustered_exact(x: Column | str, rows: int) -> Column:
    return (_c(x) - 1) / F.lit(float(rows))


def scattered(x: Column | str, rows: int) -> Column:
    return F.pmod(_c(x) - 1, F.lit(rows)).cast("double")


def randomised(x: Column | str, rows: int, seed: int) -> Column:
    """A value in [0, rows) that depends only on ``x`` and the seed."""
    return F.pmod(F.xxhash64(_c(x), F.lit(seed)), F.lit(rows)).cast("double")


def randomised_normal(rows: int, seed: int) -> Column:
    return F.abs(F.randn(seed) * rows)


def pad_random(x: Column | str, length: int, seed: int) -> Column:
    """``x`` behind random characters, ``length`` characters in all."""
    text = _c(x).cast("string")
    missing = F.greatest(F.lit(length) - F.length(text), F.lit(0))
    return F.concat(F.substring(F.randstr(length, seed), F.lit(1), missing), text)


def pad_sequence(x: Column | str, length: int) -> Column:
    """``x`` behind the digits of 1, 2, … ``length``."""
    numbers = F.sequence(F.lit(1), F.lit(length)).cast("array<string>")
    return F.concat(F.array_join(numbers, ""), _c(x).cast("string"))


def pad_single(chars: Column | str, count: int) -> Column:
    return F.repeat(_c(chars), count)


def to_int(x: Column | str) -> Column:
    """The whole part of a number or numeric text, NULL for anything else."""
    return _c(x).cast("string").try_cast("double").try_cast("int")


_SQL_FUNCTIONS = {
    "timestamp_text(ts TIMESTAMP) RETURNS STRING": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "substring_between(word STRING, first INT, last INT) RETURNS STRING": (
        "substring(word, first, last - first + 1)"
    ),
    "clustered(x DOUBLE, num_rows INT) RETURNS DOUBLE": "floor(x - 1) / num_rows",
    "clustered_exact(x DOUBLE, num_rows INT) RETURNS DOUBLE": "(x - 1) / num_rows",
    "scattered(x BIGINT, num_rows INT) RETURNS DOUBLE": "pmod(x - 1, num_rows)",
    "randomised(x BIGINT, num_rows INT, seed INT) RETURNS DOUBLE": (
        "pmod(xxhash64(x, seed), num_rows)"
    ),
    "pad_sequence(x STRING, n INT) RETURNS STRING": (
        "concat(array_join(CAST(sequence(1, n) AS ARRAY<STRING>), ''), x)"
    ),
    "pad_single(chars STRING, n INT) RETURNS STRING": "repeat(chars, n)",
    "to_int(x STRING) RETURNS INT": "try_cast(try_cast(x AS DOUBLE) AS INT)",
    "element_or_null(v ARRAY<DOUBLE>, i INT) RETURNS DOUBLE": "try_element_at(v, i + 1)",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Declare the functions for SQL text in this session; returns their names."""
    for signature, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in _SQL_FUNCTIONS]
