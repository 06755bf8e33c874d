"""External stores: one generic reader and writer with presets for each store.

The functions that build options are separate from those that use them, because the drivers
and connector jars belong to the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Store:
    """A data source format with its options."""

    format: str
    options: Mapping[str, str] = field(default_factory=dict)


def jdbc(
    url: str, table: str, user: str, password: str, driver: str, *, fetch_size: int | None = None,
    split_column: str | None = None, bounds: tuple[int, int] | None = None, splits: int | None = None,
) -> Store:
    """A JDBC table, read in ``splits`` parts of a column; the bounds place them and drop no rows.

    Without a split column one task reads all of the table, which the reader must ask for.
    """
    options = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver}
    if fetch_size is not None:
        options["fetchsize"] = str(fetch_size)
    if split_column is not None:
        if bounds is None:
            raise ValueError("a split column needs bounds")
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(splits or 1),
        }
    return Store("jdbc", options)


def bigquery(dataset: str, table: str, credentials_file: str) -> Store:
    return Store("bigquery", {"credentialsFile": credentials_file, "dataset": dataset, "table": table})


def redis(table: str, key_column: str, *, infer_schema: bool = False) -> Store:
    options = {"table": table, "key.column": key_column}
    if infer_schema:
        options["infer.schema"] = "true"
    return Store("org.apache.spark.sql.redis", options)


def read_store(spark: SparkSession, store: Store, *, one_task: bool = False) -> DataFrame:
    """Read a store; a JDBC table without a split column only when ``one_task`` is asked for."""
    if store.format == "jdbc" and "partitionColumn" not in store.options and not one_task:
        raise ValueError("name a split column, or ask for one_task")
    return spark.read.format(store.format).options(**store.options).load()


def write_store(df: DataFrame, store: Store, mode: str = "append") -> None:
    reading_only = {"fetchsize", "partitionColumn", "lowerBound", "upperBound", "infer.schema"}
    options = {k: v for k, v in store.options.items() if k not in reading_only}
    df.write.format(store.format).options(**options).mode(mode).save()
