"""Indexing, encoding and scaling for models, without gathering labels on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.operators.cleaning import clean_name, string_columns
from deedscope.operators.profiling import value_counts
from deedscope.plans.lineage import cut_lineage
from deedscope.plans.ordinal import with_row_number
from deedscope.plans.sizing import TooManyRows, broadcast_if_small

# Fixed value: the text a missing label is encoded as.
MISSING_LABEL = "None"


def label_positions(
    df: DataFrame, column: str, *, order: str = "frequency", counts: DataFrame | None = None, missing: str | None = None
) -> DataFrame:
    """(label, position from 0, rows), by falling frequency then label, or by label alone.

    The labels are numbered by a distributed sort, so a column of addresses is no problem.
    ``counts`` are the table's :func:`value_counts`, where they are known already; ``missing`` is
    the label that NULL counts as, by default none.
    """
    if counts is None:
        counts = df.select(F.col(column).alias("value")).groupBy("value").agg(F.count("*").alias("num_rows"))
    else:
        counts = counts.filter(F.col("column_name") == column)
    label = F.col("value") if missing is None else F.coalesce("value", F.lit(missing))
    counts = counts.filter(label.isNotNull()).groupBy(label.alias("label")).agg(F.sum("num_rows").alias("num_rows"))
    by = {"frequency": [F.desc("num_rows"), F.asc("label")], "alphabet": [F.asc("label")]}[order]
    numbered = with_row_number(counts, by, "position")
    return numbered.select("label", (F.col("position") - 1).alias("position"), "num_rows")


def string_index(
    df: DataFrame, column: str, *, invalid: str = "skip", output: str | None = None,
    positions: DataFrame | None = None,
) -> DataFrame:
    """Add the label's position as a double; ``skip`` drops NULL and unseen labels, ``keep``
    gives them the position after the last."""
    if invalid not in ("skip", "keep"):
        raise ValueError("invalid is skip or keep")
    output = output or f"{column}_index"
    positions = label_positions(df, column) if positions is None else positions
    lookup = broadcast_if_small(
        positions.select(F.col("label").alias("__label"), F.col("position").cast("double").alias(output))
    )
    joined = df.join(
        lookup, F.col(column) == F.col("__label"), "inner" if invalid == "skip" else "left"
    ).drop("__label")
    if invalid == "keep":
        after_last = positions.agg(F.count("*").cast("double").alias("n")).scalar()
        joined = joined.withColumn(output, F.coalesce(output, after_last))
    return joined


def categories(
    df: DataFrame, columns: Sequence[str], max_width: int = 1_000, *, counts: DataFrame | None = None
) -> dict[str, list[str]]:
    """The values of each column, sorted; refuses a column of more than ``max_width`` values.

    ``counts`` are the columns' :func:`value_counts`, where they are known already.
    """
    counts = cut_lineage(value_counts(df, columns)) if counts is None else counts
    known = counts.filter(F.col("value").isNotNull() & F.col("column_name").isin(list(columns)))
    wide = known.groupBy("column_name").agg(F.count("*").alias("n")).filter(F.col("n") > max_width).collect()
    if wide:
        raise TooManyRows("; ".join(f"{r['column_name']}: {r['n']} categories" for r in wide))
    # At most ``max_width`` rows a column.
    found = known.select("column_name", "value").collect()
    return {c: sorted(r["value"] for r in found if r["column_name"] == c) for c in columns}


def dummies(
    df: DataFrame, columns: Sequence[str], *, max_width: int = 1_000, counts: DataFrame | None = None
) -> DataFrame:
    """Replace each column by 0/1 columns, one per category; NULL is 0 in all of them."""
    values = categories(df, columns, max_width, counts=counts) if columns else {}
    encoded = [
        F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(clean_name(f"{c}_{v}"))
        for c in columns
        for v in values[c]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *encoded)


def widths_of(counts: DataFrame) -> dict[str, int]:
    """Distinct values per column, NULL left out, from its value counts."""
    return {r["column_name"]: r["n"] for r in counts.groupBy("column_name").agg(F.count("value").alias("n")).collect()}


def encode_table(
    df: DataFrame, columns: Sequence[str] | None = None, *, label_above: int = 100
) -> DataFrame:
    """Labels for columns with more than ``label_above`` values, 0/1 columns for the others.

    Widths, labels and categories come from one pass over the table.
    """
    columns = list(columns or string_columns(df))
    counts = cut_lineage(value_counts(df, columns))
    widths = widths_of(counts)
    # A table without rows has no counts at all.
    wide = [c for c in columns if widths.get(c, 0) > label_above]
    for c in wide:
        named = df.withColumn(c, F.coalesce(F.col(c), F.lit(MISSING_LABEL)))
        positions = label_positions(named, c, order="alphabet", counts=counts, missing=MISSING_LABEL)
        df = string_index(named, c, output="__code", positions=positions)
        df = df.withColumn(c, F.col("__code").cast("bigint")).drop("__code")
    return dummies(df, [c for c in columns if c not in wide], counts=counts)


_MOMENTS = {"mean": F.avg, "std": F.stddev_pop}


class Scaling:
    """Mean and population standard deviation per column, fitted in one pass; 0 scales by 1."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        statistics = [f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in _MOMENTS.items()]
        row = df.agg(*statistics).first()
        self._mean = {c: row[f"mean_{i}"] for i, c in enumerate(columns)}
        self._deviation = {c: row[f"std_{i}"] or 1.0 for i, c in enumerate(columns)}

    def mean(self, column: str) -> Column:
        return F.lit(self._mean[column])

    def deviation(self, column: str) -> Column:
        return F.lit(self._deviation[column])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - self.mean(c)) / self.deviation(c) for c in self.columns}
        )

    def invert(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.col(c) * self.deviation(c) + self.mean(c) for c in self.columns}
        )


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return Scaling(df, columns).apply(df)
