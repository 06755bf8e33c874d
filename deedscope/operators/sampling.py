"""Sampling, augmentation, splits and set operations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.functions.scalars import _let, hashed_unit


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in random order, by a distributed sort."""
    return df.orderBy(F.rand(seed))


def poisson_count(unit: Column, mean: float) -> Column:
    """The Poisson number of a mean at a number in [0, 1), by inverting the distribution.

    ``unit`` may be costly: it is evaluated once, not at each step.
    """
    term = total = math.exp(-mean)
    steps = [total]
    while len(steps) < mean + 12 * math.sqrt(mean) + 20:
        term *= mean / len(steps)
        total += term
        steps.append(total)
    return _let(unit, lambda u: F.size(F.filter(F.array(*[F.lit(x) for x in steps]), lambda c: c < u)))


def bootstrap(df: DataFrame, fraction: float, seed: int = 42, *, key: Sequence[str] | None = None) -> DataFrame:
    """Sample with replacement; ``fraction`` of the rows is the expected size.

    How often a row is drawn depends on the seed and its ``key`` (by default all its columns)
    only, so partitions and reruns don't change the sample. Rows of equal key are drawn alike.
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in key or df.columns]
    # Rows that are not drawn are told by the first step alone.
    drawn = df.withColumn("__u", hashed_unit(F.lit(seed), *parts)).filter(F.col("__u") > math.exp(-fraction))
    copies = F.explode(F.sequence(F.lit(1), poisson_count(F.col("__u"), fraction)))
    return drawn.select(*[F.col(f"`{c}`") for c in df.columns], copies.alias("__copy")).drop("__copy")


def augment(df: DataFrame, fraction: float, seed: int = 42, *, key: Sequence[str] | None = None) -> DataFrame:
    """The rows and a bootstrap sample of them, shuffled."""
    return shuffle_rows(df.unionByName(bootstrap(df, fraction, seed, key=key)), seed)


def random_split(df: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    first, second = df.randomSplit([share, 1 - share], seed)
    return first, second


def hash_split(
    df: DataFrame, key: Column | str, share: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """A split that depends on the key only: the same rows on every run and every cluster."""
    column = F.col(key) if isinstance(key, str) else key
    first = hashed_unit(F.lit(seed), column) < share
    return df.filter(first), df.filter(~first)


def cap_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """UNION ALL by position."""
    return first.union(second)
