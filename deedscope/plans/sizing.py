"""Checks that come before anything is broadcast or brought to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class TooManyRows(ValueError):
    """A result that must be small is not."""


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` holds no more than ``max_rows`` rows; reads only that many plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def bytes_of(df: DataFrame) -> int:
    """Bytes of a table's values, by one count: texts by their length, other columns eight each."""
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    parts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in texts]
    row = sum(parts, F.lit(8 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Bring a small result to the driver, or refuse; never a truncated result."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooManyRows(f"{what}: more than {max_rows} rows")
    return rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only for a counted side; a larger side is joined by shuffle."""
    return F.broadcast(df) if has_at_most(df, max_rows) else df
