"""Generated tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deedscope.functions.scalars import hashed_unit
from deedscope.plans.ordinal import with_row_number


def rate_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def numbered_stream(spark: SparkSession, rows_per_batch: int, *, partitions: int | None = None, start_ms: int = 0) -> DataFrame:
    """A stream of consecutive numbers, ``rows_per_batch`` in each micro-batch, with timestamps from ``start_ms``.

    Which numbers a batch holds depends on the batch alone, so a restart repeats none and misses none.
    """
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("startTimestamp", start_ms)
    if partitions:
        reader = reader.option("numPartitions", partitions)
    return reader.load()


def hourly_columns(position: Column, start: str = "2024-01-01 00:00:00") -> list[Column]:
    """``dt`` and ``hr`` of the hour at a zero-based position.

    Hours repeat after 2**31 positions (245,000 years), the most that can be added.
    """
    hour = F.timestamp_add("HOUR", F.pmod(position, F.lit(1 << 31)).cast("int"), F.lit(start).cast("timestamp_ntz"))
    return [F.date_format(hour, "yyyy-MM-dd").alias("dt"), F.date_format(hour, "HH").alias("hr")]


def large_table(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Ids from 1, a whole number in [0, 100), a number in [0, 100), and consecutive hours."""
    return spark.range(1, rows + 1).select(
        F.col("id").alias("id1"),
        F.floor(F.rand(seed) * 100).cast("int").alias("feature_1"),
        (F.rand(seed + 1) * 100).alias("feature_2"),
        *hourly_columns(F.col("id") - 1),
    )


def small_table(ids: DataFrame, rows: int, id_column: str = "id1", seed: int = 42) -> DataFrame:
    """``rows`` of the ids without repetition, picked by a hash of id and seed."""
    picked = ids.select(
        F.col(id_column).alias("id2"), hashed_unit(F.lit(seed), F.col(id_column)).alias("__h")
    )
    numbered = with_row_number(picked, [F.asc("__h"), F.asc("id2")], "__n")
    return numbered.filter(F.col("__n") <= rows).select(
        "id2",
        F.concat(F.lit("place-"), F.pmod(F.floor(F.col("__h") * 1e6), F.lit(1_000)).cast("string")).alias("small_feature_1"),
        (hashed_unit(F.lit(seed + 1), F.col("id2")) * 50).alias("small_feature_2"),
        *hourly_columns(F.col("__n") - 1),
    )
