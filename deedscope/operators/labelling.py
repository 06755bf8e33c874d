"""Rule-based labels under three-valued logic: a condition that is unknown does not flag."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedscope.operators.joins import rows_without_match


def label_by_owner(
    df: DataFrame, *, high_price: float = 1_000_000, home_country: str = "UK"
) -> DataFrame:
    """Flag high prices, a missing first owner, or an owner from abroad."""
    missing = F.col("proprietor1").isNull()
    flagged = (
        (F.col("price_paid") > high_price)
        | missing
        | (F.col("country") != home_country)
    )
    return df.withColumn("is_fraud", F.when(flagged, 1).otherwise(0))


def label_by_gaps(
    df: DataFrame, *, high_price: float = 1_000_000, home_country: str = "UK"
) -> DataFrame:
    """Flag high prices, gaps in owner names or address, or an owner from abroad.

    ``missing_proprietor_name`` is 1 when either owner name is missing.
    """
    missing = F.col("proprietor1").isNull() | F.col("proprietor2").isNull()
    return df.withColumn("missing_proprietor_name", missing.cast("int")).withColumn(
        "is_fraud",
        F.when(F.col("price_paid") > high_price, 1)
        .when(missing | F.col("address1").isNull(), 1)
        .when(F.col("country") != home_country, 1)
        .when(F.col("missing_proprietor_name") == 1, 1)
        .otherwise(0),
    )


def label_by_average(
    df: DataFrame, *, limit: float = 1_000_000, price_column: str = "average_price",
    label: str = "is_fraud", mirrored: bool = False,
) -> DataFrame:
    """0 below the limit, else 1; an unknown average is 1. ``mirrored`` swaps the two."""
    below, other = (1, 0) if mirrored else (0, 1)
    return df.withColumn(label, F.when(F.col(price_column) < limit, below).otherwise(other))


def split_scorable(
    df: DataFrame, *, required: Sequence[str], key: str | None = None, **rules
) -> tuple[DataFrame, DataFrame]:
    """Label the complete rows; return them and the rows left out for a missing value.

    Indexing and assembling with "skip" only drops rows with a NULL among ``required``, so the
    NULLs are dropped directly. The rest are the other rows, found in the same scan. Where a key
    has several rows, name it: the rest are then the rows whose key is not among the labelled.
    """
    labelled = label_by_gaps(df.dropna(subset=list(required)), **rules)
    if key is not None:
        return labelled, rows_without_match(df, labelled, key)
    return labelled, df.filter(reduce(or_, [F.col(c).isNull() for c in required]))
