"""Joins of ledgers, indexes and bucketed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedscope.plans.sizing import bytes_of
from deedscope.plans.skew import join_split_hot


def labels_beside_source(
    raw: DataFrame, labelled: DataFrame, key: str, source_columns: Sequence[str],
    label_columns: Sequence[str] = ("is_fraud",),
) -> DataFrame:
    """Inner join of raw and labelled rows on the title key."""
    a, b = raw.alias("a"), labelled.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(
        *[F.col(f"b.{c}").alias(c) for c in label_columns],
        F.col(f"a.{key}").alias(key),
        *[F.col(f"a.{c}").alias(c) for c in source_columns],
    )


def rows_without_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``other``; a NULL key has no match and stays."""
    # Distinct keys: a key repeated many times on the other side is summed up before the shuffle.
    return df.join(other.select(key).distinct(), key, "left_anti")


def join_on_shared_text(left: DataFrame, right: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Inner join on every shared column that is not numeric; NULL keys never match."""
    shared = [c for c in left.columns if c in right.columns and c not in numeric]
    return left.join(right.select(*shared), shared)


def distinct_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str,
    *, key_name: str = "region_name", prefixes: tuple[str, str] = ("gd_", "bd_"),
) -> DataFrame:
    """DISTINCT rows of a join on lower-cased names, all columns of both sides kept.

    Both sides are made distinct before they meet: with all their columns in the result this is
    the same set, and duplicate rows never multiply in the join. Columns are prefixed because
    the two tables share names.
    """
    def prepared(df: DataFrame, prefix: str) -> DataFrame:
        return df.distinct().toDF(*[prefix + c for c in df.columns])

    a, b = prepared(left, prefixes[0]), prepared(right, prefixes[1])
    a_key, b_key = F.lower(prefixes[0] + left_key), F.lower(prefixes[1] + right_key)
    return a.join(b, a_key == b_key).select(F.coalesce(b_key, a_key).alias(key_name), "*")


def with_width_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row's columns padded to the widest text of the table, for a fixed-width listing.

    The widths are one row, read as a scalar, so no row is paired with another.
    """
    widths = df.agg(
        F.struct(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in columns]).alias("w")
    ).scalar()
    return df.select(
        *[F.rpad(F.col(c).cast("string"), widths.getField(c), F.lit(" ")).alias(c) for c in columns],
        F.concat_ws(
            "-+-", *[F.repeat(F.lit("-"), widths.getField(c)) for c in columns]
        ).alias("rule"),
    )


def bucketed_left_join(
    large: DataFrame, small: DataFrame, large_key: str, small_key: str, *, hot_share: float = 0.05,
    broadcast_bytes: int = 0, order_by: Sequence[str] = (),
) -> DataFrame:
    """LEFT join of two tables bucketed alike: no exchange, and hot keys spread apart.

    Filter a partitioned table before, so that only those partitions are read. A right side whose
    columns' bytes, as counted, are at most ``broadcast_bytes`` is broadcast instead.
    ``order_by`` sorts the result by columns of it.
    """
    joined = _bucketed(large, small, large_key, small_key, hot_share, broadcast_bytes)
    return joined.orderBy(*order_by) if order_by else joined


def unequal_buckets_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, ratio: int, how: str = "left"
) -> DataFrame:
    """Join of two bucketed tables of which one has a multiple of the other's buckets: no exchange.

    Several buckets of the finer table are read as one of the coarser. Where it has more than
    ``ratio`` times as many, one task would read too much, and the coarser table is shuffled
    instead. The session keeps the setting, which the plan is made with when the result is read.
    """
    conf = left.sparkSession.conf
    conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    conf.set("spark.sql.bucketing.coalesceBucketsInJoin.maxBucketRatio", str(ratio))
    # A broadcast would not read by bucket.
    return left.join(right.hint("merge"), F.col(left_key) == F.col(right_key), how)


def _bucketed(large, small, large_key, small_key, hot_share, broadcast_bytes) -> DataFrame:
    if broadcast_bytes and bytes_of(small) <= broadcast_bytes:
        return large.join(F.broadcast(small), F.col(large_key) == F.col(small_key), "left")
    return join_split_hot(large, small, large_key, small_key, "left", share=hot_share)
