"""Catalog tables: guarded scans and table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from deedscope.operators.cleaning import clean_names, conform
from deedscope.plans.skew import hot_keys, spread_salt


def schema_exists(spark: SparkSession, name: str) -> bool:
    """Whether a database exists, in any letter case."""
    return any(db.name.lower() == name.lower() for db in spark.catalog.listDatabases())


def scan_table(spark: SparkSession, table: str, *, statistics: str | None = "size") -> DataFrame:
    """A table that must exist, its statistics refreshed for the optimiser.

    ``statistics`` "size" looks at the files only; "rows" reads the table to count it too.
    """
    if not spark.catalog.tableExists(table):
        raise LookupError(f"no such table: {table}")
    if statistics is not None:
        extent = {"size": " NOSCAN", "rows": ""}[statistics]
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS{extent}")
    return spark.table(table)


def scan_pair(spark: SparkSession, good: str, bad: str, **options) -> tuple[DataFrame, DataFrame]:
    return scan_table(spark, good, **options), scan_table(spark, bad, **options)


def write_table(df: DataFrame, table: str, *, schema: T.StructType | str | None = None) -> None:
    """Overwrite a managed table; a schema, if given, is enforced, not just declared."""
    result = conform(df, schema) if schema is not None else df
    result.write.mode("overwrite").saveAsTable(table)


def write_clean_table(df: DataFrame, table: str, *, schema: T.StructType | str | None = None) -> None:
    """Clean the column names, then overwrite the table."""
    write_table(clean_names(df), table, schema=schema)


def create_table_as(spark: SparkSession, table: str, select: str) -> list[tuple[str, str]]:
    """Replace a table by a query's result; returns its columns and types."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} USING parquet AS {select}")
    return [(r["col_name"], r["data_type"]) for r in spark.sql(f"DESCRIBE TABLE {table}").collect()]


def create_text_table(spark: SparkSession, table: str, location: str) -> DataFrame:
    """An external table over text files, one string column."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (value STRING) USING text LOCATION '{location}'")
    return spark.table(table)


def buckets_for(df: DataFrame, *, bucket_rows: int = 5_000_000, tasks: int | None = None) -> int:
    """As many buckets as keep each at ``bucket_rows`` rows, and all tasks of a shuffle at work."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks, -(-df.count() // bucket_rows))


def write_bucketed(
    df: DataFrame, table: str, *, key: str, buckets: int, partition_by: Sequence[str] = (),
    path: str | None = None, hot_share: float = 0.05, salts: int = 16,
) -> None:
    """A bucketed, sorted parquet table, optionally partitioned and external.

    The rows are first shuffled as the buckets are laid out, so a bucket is one file (per
    partition) and not one file per task. Keys with a large share of the rows are spread over
    ``salts`` tasks, which only gives their bucket more files.
    """
    hot = hot_keys(df, key, hot_share)
    if hot:
        from pyspark.sql import functions as F

        salt = F.when(F.col(key).isin(hot), spread_salt(df, salts)).otherwise(F.lit(0))
        laid_out = df.withColumn("__salt", salt).repartition(buckets, key, "__salt").drop("__salt")
    else:
        laid_out = df.repartition(buckets, key)
    writer = laid_out.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def register_views(**views: DataFrame) -> None:
    """Make DataFrames readable from SQL text under the given names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
