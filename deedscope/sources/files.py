"""Files: delimited text, lines, parquet, JSON documents of parallel arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedscope.plans.sizing import TooManyRows, has_at_most

# The layout of card transaction files.
CARD_TRANSACTIONS = (
    "transaction_id INT, amount DOUBLE, merchant STRING, category STRING, is_fraud BOOLEAN"
)


def read_delimited(spark: SparkSession, path: str, schema: str = CARD_TRANSACTIONS, *, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with types inferred, at the price of reading the files twice."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parallel_arrays(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Rows from JSON documents that hold one array per column (name to element type).

    Arrays of different lengths are an error, not rows with gaps.
    """
    ddl = ", ".join(f"`{c}` array<{t}>" for c, t in columns.items())
    document = spark.read.schema(ddl).json(path, multiLine=True)
    names = list(columns)
    sizes = F.array_distinct(F.array(*[F.size(F.col(f"`{c}`")) for c in names]))
    checked = F.when(F.size(sizes) == 1, F.arrays_zip(*[F.col(f"`{c}`") for c in names])).otherwise(
        F.raise_error(F.lit("arrays differ in length")).cast(
            "array<struct<" + ",".join(f"`{c}`:{t}" for c, t in columns.items()) + ">>"
        )
    )
    return document.select(F.inline(checked)).toDF(*names)


def read_json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records from whole JSON documents."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def write_single_csv(df: DataFrame, path: str, *, max_rows: int | None = None) -> None:
    """One CSV file with a header, for a report. One task writes it; nothing is left out.

    With ``max_rows`` a larger table is refused instead, before anything is written.

    The shuffle before the single writer keeps the stages above it parallel.
    """
    if max_rows is not None and not has_at_most(df, max_rows):
        raise TooManyRows(f"more than {max_rows} rows do not belong in one file")
    df.repartition(1).write.mode("overwrite").csv(path, header=True)


def share_lines(df: DataFrame, name: str, percent: str) -> DataFrame:
    """The report as one text column."""
    from deedscope.functions.scalars import share_line

    return df.select(share_line(name, percent).alias("value"))
