"""Micro-batch enrichment of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from deedscope.functions.scalars import square


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, *, pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream over the parquet files of a folder, optionally those with matching names."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_square(stream: DataFrame, value: str, output: str = "value_squared") -> DataFrame:
    """Stateless projection; works on a batch as well."""
    return stream.withColumn(output, square(value))


def looked_up(stream: DataFrame, table: DataFrame, stream_key: str, table_key: str, *, how: str = "inner") -> DataFrame:
    """A stream's rows with those of a static table of the same key; the table is read anew for each batch."""
    return stream.join(table, F.col(stream_key) == F.col(table_key), how)


# Fixed value: the wording of the question.
PROMPT = (
    "The value is %s and its square is %s. "
    "Provide some interesting insights or context about these numbers."
)


def insight_prompt(value: Column, squared: Column) -> Column:
    """The question about a number and its square that a later service call would ask."""
    return F.format_string(PROMPT, value.cast("string"), squared.cast("string"))


def with_prompt(batch: DataFrame, value: str, squared: str = "value_squared") -> DataFrame:
    return batch.withColumn("prompt", insight_prompt(F.col(value), F.col(squared)))


def run_enrichment(
    stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], *, output: str, checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Enrich every micro-batch and write it below ``output`` in a folder of its own batch id.

    A batch that is run again after a failure overwrites its own folder, so rows are written
    exactly once. The batch stays a DataFrame: nothing is brought to the driver.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    writer = (
        stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_console(stream: DataFrame, *, checkpoint: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").format("console")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
