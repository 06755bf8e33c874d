"""What several document operators share: reading, columns, and skew-safe facts about groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deedscope.workload.tables import read

# The word characters of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels")


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` with the fields of ``ddl`` after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_parts(
    batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 21, rows: int = 4096
) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text, so that long texts don't add up in a task."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(lengths[at : at + rows]), size, side="right"))
            yield batch.slice(at, max(1, fit))
            at += max(1, fit)


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def with_group_facts(
    rows: DataFrame, keys: Sequence[str], value: str, best: str, first: str, size: str, salts: int = 32, combined: bool = True
) -> DataFrame:
    """Add to each row the least or greatest ``value`` of its group and the group's size.

    Groups are combined in three steps: within each input partition and salt, over the salts,
    and back on (keys, salt). So no task gets more than about 1/``salts`` of a hot group, and a
    hot group's rows meet nowhere. The salt is a hash of ``value``, which a rerun repeats. Keys
    must not be NULL. ``best`` is ``min`` or ``max``. With ``combined`` false, rows are dealt by key
    and salt once, for the facts and for the join; that saves a shuffle where most groups are small.
    """
    pick = {"min": F.min, "max": F.max}[best]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    if not combined:
        salted = salted.repartition(*keys, "__salt")
    local = salted.groupBy(*keys, "__salt").agg(pick(value).alias(first), F.count("*").alias(size))
    whole = local.groupBy(*keys).agg(
        pick(first).alias(first),
        F.sum(size).alias(size),
        F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts"),
    )
    present = F.filter(
        F.sequence(F.lit(0), F.lit(salts - 1)),
        lambda s: F.col("__salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0,
    )
    spread = whole.withColumn("__salt", F.explode(present)).drop("__salts")
    return salted.join(spread, [*keys, "__salt"]).drop("__salt")


def salted_left_join(rows: DataFrame, facts: DataFrame, key: str, spread_by: str, salts: int = 32) -> DataFrame:
    """Left join to ``facts``, unique by ``key``, with the rows of a hot key spread over ``salts``.

    Each fact goes to those salts only at which its key has rows.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    spread = salted.select(key, "__salt").distinct().join(facts, key)
    return salted.join(spread, [key, "__salt"], "left").drop("__salt")
