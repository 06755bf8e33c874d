"""Positions and running totals over one global order, without a one-task window.

A window without PARTITION BY moves every row into one task. Here the rows are range
partitioned, each partition is numbered by itself, and the totals of the partitions before
it (one row per partition) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedscope.plans.lineage import cut_lineage

_SLOT = "__slot"


def with_running_totals(
    df: DataFrame, order_by: Sequence[Column], totals: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums of ``totals`` in the order ``order_by``.

    ``order_by`` must order the rows totally: aggregate equal keys first, which also removes
    hot keys.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order_by).withColumn(_SLOT, F.spark_partition_id())
    )
    # One row per shuffle partition, so this window and the broadcast stay small.
    before = Window.orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy(_SLOT)
        .agg(*[F.sum(expr).alias(name) for name, expr in totals.items()])
        .select(
            _SLOT,
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in totals],
        )
    )
    within = (
        Window.partitionBy(_SLOT)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = placed.select(
        "*", *[F.sum(expr).over(within).alias(f"__in_{n}") for n, expr in totals.items()]
    )
    return numbered.join(F.broadcast(carried), _SLOT).select(
        *df.columns, *[(F.col(f"__in_{n}") + F.col(f"__before_{n}")).alias(n) for n in totals]
    )


def with_row_number(df: DataFrame, order_by: Sequence[Column], name: str) -> DataFrame:
    """Number the rows 1, 2, 3 … in the total order ``order_by``."""
    return with_running_totals(df, order_by, {name: F.lit(1).cast("bigint")})
