"""Column profiles: one pass over the table where the plain way takes one job per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedscope.operators.cleaning import numeric_columns, string_columns
from deedscope.operators.gram import pairwise_correlations
from deedscope.operators.quantiles import exact_quantiles
from deedscope.plans.lineage import cut_lineage


def _rows_from_struct(one_row: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Turn one wide row of ``<prefix>_<position>`` values into one row per column."""
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"{prefix}_{i}").alias(field) for field, prefix in fields.items()],
        )
        for i, c in enumerate(columns)
    ]
    return one_row.select("rows", F.explode(F.array(*entries)).alias("e")).select("rows", "e.*")


def null_percentages(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the NULL count and its percentage of the rows, to one decimal."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count("*").alias("rows"), *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(columns)]
    )
    per_column = _rows_from_struct(counted, columns, {"present": "n"})
    nulls = F.col("rows") - F.col("present")
    return per_column.select(
        "column_name",
        nulls.alias("null_count"),
        F.when(F.col("rows") > 0, F.round(nulls / F.col("rows") * 100, 1))
        .otherwise(F.lit(0.0))
        .alias("null_percentage"),
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: columns, those with NULLs, and the percentage that is entirely NULL."""
    share = F.col("null_percentage")
    return null_percentages(df, columns).agg(
        F.count("*").alias("num_columns"),
        F.count_if(share > 0).alias("columns_with_null"),
        F.array_join(F.array_sort(F.collect_list(F.when(share > 0, F.col("column_name")))), ",").alias(
            "names_with_null"
        ),
        F.round(F.count_if(share == 100) / F.count("*") * 100, 2).alias("null_columns_percentage"),
    )


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) for all string columns at once; NULL is counted as a value.

    The rows are unpivoted in the map stage and summed before the shuffle, so a frequent
    value reaches the shuffle once per task.
    """
    columns = list(columns or string_columns(df))
    # Adding zero makes -0.0 and 0.0 one value, as they are in comparisons.
    fractional = {c for c in columns if isinstance(df.schema[c].dataType, T.FractionalType)}
    as_text = df.select(
        *[(F.col(c) + F.lit(0).cast(df.schema[c].dataType) if c in fractional else F.col(c)).cast("string").alias(c) for c in columns]
    )
    return (
        as_text.unpivot([], columns, "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("num_rows"))
    )


def null_and_distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the NULL percentage and the exact number of values, NULL being one."""
    counts = value_counts(df, columns or df.columns)
    nulls = F.sum(F.when(F.col("value").isNull(), F.col("num_rows")).otherwise(0))
    return counts.groupBy("column_name").agg(
        F.round(nulls / F.sum("num_rows") * 100, 1).alias("null_percentage"),
        F.count("*").alias("distinct_count"),
    )


def distinct_widths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-NULL values per column, and their sum: the width of a one-hot encoding."""
    counts = value_counts(df, columns)
    per_column = counts.groupBy("column_name").agg(F.count("value").alias("distinct_values"))
    return per_column.rollup("column_name").agg(F.sum("distinct_values").alias("distinct_values")).select(
        F.coalesce("column_name", F.lit("(total)")).alias("column_name"), "distinct_values"
    )


def sketch_columns(df: DataFrame, by: Sequence[str], *, distinct: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Mergeable profiles, one row per value of ``by``: rows, and per column a binary sketch.

    ``<c>_distinct`` holds a distinct-count sketch (standard error about 1.6 %), ``<c>_quantiles``
    one of quantiles (rank error about 1.7 %), ``<c>_nulls`` the NULLs. Written to a table they need
    not be made again: profiles of new rows are merged with those kept (:func:`merge_sketches`).
    """
    parts = [F.count("*").alias("num_rows")]
    for c in dict.fromkeys([*distinct, *numbers]):
        parts.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}_nulls"))
    parts += [F.hll_sketch_agg(f"`{c}`", F.lit(12)).alias(f"{c}_distinct") for c in distinct]
    parts += [F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double")).alias(f"{c}_quantiles") for c in numbers]
    return df.groupBy(*by).agg(*parts)


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kept profiles joined to coarser ones: counts are added, sketches merged."""
    parts = []
    for c in sketches.columns:
        if c.endswith("_distinct"):
            parts.append(F.hll_union_agg(f"`{c}`").alias(c))
        elif c.endswith("_quantiles"):
            parts.append(F.kll_merge_agg_double(f"`{c}`").alias(c))
        elif c == "num_rows" or c.endswith("_nulls"):
            parts.append(F.sum(f"`{c}`").alias(c))
    return sketches.groupBy(*by).agg(*parts)


def read_sketches(sketches: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profiles in numbers: each distinct count, and each quantile as an array."""
    shown = []
    for c in sketches.columns:
        if c.endswith("_distinct"):
            shown.append(F.hll_sketch_estimate(f"`{c}`").alias(c))
        elif c.endswith("_quantiles"):
            parts = [F.kll_sketch_get_quantile_double(F.col(f"`{c}`"), F.lit(float(p))) for p in probabilities]
            shown.append(F.array(*parts).alias(c))
        else:
            shown.append(F.col(f"`{c}`"))
    return sketches.select(*shown)


def _is_empty(df: DataFrame, column: str) -> Column:
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        return value.isNull() | (value == "")
    return value.isNull()


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, *, approximate: bool = False, bins: int = 10
) -> DataFrame:
    """One row per column: type, empty and distinct counts and shares, min, max, average, and an
    equal-width histogram of each numeric column as an array of (left edge, right edge, rows).

    A name the table does not have yields a row with ``column_exists`` false. The distinct share leaves
    the empty cells out of the distinct count, as the report always did, so it can be negative.
    Exact distinct counts shuffle the distinct values, which also give the histogram: two scans.
    ``approximate`` needs one scan and leaves the histogram out.
    """
    wanted = list(columns or df.columns)
    known = [c for c in wanted if c in df.columns]
    numeric = {c for c in known if isinstance(df.schema[c].dataType, T.NumericType)}

    def number(fn, column: str) -> Column:
        return fn(F.col(column)).cast("double") if column in numeric else F.lit(None).cast("double")

    aggregates: list[Column] = [F.count("*").alias("rows")]
    for i, c in enumerate(known):
        aggregates += [
            F.count_if(_is_empty(df, c)).alias(f"empty_{i}"),
            (number(F.min, c) if c in numeric else F.max(F.lit(None).cast("double"))).alias(f"min_{i}"),
            (number(F.max, c) if c in numeric else F.max(F.lit(None).cast("double"))).alias(f"max_{i}"),
            (number(F.avg, c) if c in numeric else F.max(F.lit(None).cast("double"))).alias(f"avg_{i}"),
        ]
        if approximate:
            aggregates.append(F.approx_count_distinct(F.col(c)).alias(f"distinct_{i}"))
    fields = {"null_count": "empty", "min_value": "min", "max_value": "max", "avg_value": "avg"}
    if approximate:
        fields["distinct_count"] = "distinct"
    profile = _rows_from_struct(df.agg(*aggregates), known, fields)
    if not approximate:
        profile = cut_lineage(profile)
        counts = cut_lineage(value_counts(df, known))
        distinct = counts.groupBy("column_name").agg(F.count("*").alias("distinct_count"))
        profile = profile.join(distinct, "column_name", "left").join(
            _histograms(counts, profile, sorted(numeric), bins), "column_name", "left"
        )

    kinds = F.create_map(*[F.lit(x) for c in known for x in (c, df.schema[c].dataType.simpleString())])
    rows = F.col("rows")

    def share(part: Column) -> Column:
        return F.when(rows > 0, F.round(part / rows * 100, 2)).otherwise(F.lit(0.0))

    profile = profile.select(
        "column_name",
        F.lit(True).alias("column_exists"),
        F.element_at(kinds, F.col("column_name")).alias("data_type"),
        rows.alias("num_rows"),
        "null_count",
        share(F.col("null_count")).alias("null_percentage"),
        F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count"),
        share(F.coalesce("distinct_count", F.lit(0)) - F.col("null_count")).alias("distinct_percentage"),
        "min_value",
        "max_value",
        F.round("avg_value", 2).alias("avg_value"),
        *([] if approximate else ["histogram"]),
    )
    unknown = [(c, False) for c in wanted if c not in df.columns]
    if unknown:
        absent = df.sparkSession.createDataFrame(unknown, "column_name string, column_exists boolean")
        profile = profile.unionByName(absent, allowMissingColumns=True)
    return profile


def _histograms(counts: DataFrame, profile: DataFrame, numeric: list[str], bins: int) -> DataFrame:
    """``column_name`` and ``histogram`` of the numeric columns, from the counts of their values.

    A single value is centred in a range of width one; a column without values has none.
    """
    flat = F.col("min_value") == F.col("max_value")
    edges = profile.filter(F.col("column_name").isin(numeric) & F.col("min_value").isNotNull()).select(
        "column_name",
        F.when(flat, F.col("min_value") - 0.5).otherwise(F.col("min_value")).alias("lo"),
        F.when(flat, F.col("max_value") + 0.5).otherwise(F.col("max_value")).alias("hi"),
    )
    value = F.col("value").try_cast("double")
    slot = F.least(F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    # ``edges`` has a row for each numeric column of the table at most.
    filled = (
        counts.filter(F.col("value").isNotNull())
        .join(F.broadcast(edges), "column_name")
        .groupBy("column_name", slot.alias("bin"))
        .agg(F.sum("num_rows").alias("n"))
        .groupBy("column_name")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled"))
    )
    step = (F.col("hi") - F.col("lo")) / bins
    one_bin = lambda b: F.struct(
        (F.col("lo") + b * step).alias("left_edge"),
        F.when(b == bins - 1, F.col("hi")).otherwise(F.col("lo") + (b + 1) * step).alias("right_edge"),
        F.coalesce(F.try_element_at("filled", b), F.lit(0)).cast("bigint").alias("num_rows"),
    )
    return edges.join(filled, "column_name").select(
        "column_name", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one_bin).alias("histogram")
    )


def explore(df: DataFrame, numbers: Sequence[str], pairs: Sequence[tuple[str, str]], texts: Sequence[str]) -> DataFrame:
    """Means, missing shares, correlations and distinct counts as (section, item, amount) rows.

    One scan for all that an aggregate gives, one for the distinct counts.
    """
    columns = df.columns
    wide = df.agg(
        F.count("*").alias("rows"),
        *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{i}") for i, c in enumerate(numbers)],
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)],
    )
    missing = lambda i: F.when(F.col("rows") > 0, F.round((F.col("rows") - F.col(f"n_{i}")) / F.col("rows") * 100, 1)).otherwise(0.0)
    cells = [
        *[("describe", c, F.round(f"mean_{i}", 6)) for i, c in enumerate(numbers)],
        *[("missing", c, missing(i)) for i, c in enumerate(columns)],
        *[("correlation", ",".join(pair), F.round(f"r_{i}", 6)) for i, pair in enumerate(pairs)],
    ]
    entries = [F.struct(F.lit(s).alias("section"), F.lit(c).alias("item"), v.cast("double").alias("amount")) for s, c, v in cells]
    distinct = null_and_distinct(df, texts).select(
        F.lit("distinct").alias("section"), F.col("column_name").alias("item"), F.col("distinct_count").cast("double").alias("amount")
    )
    return wide.select(F.inline(F.array(*entries))).unionByName(distinct)


def profile_json(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The profile as one JSON document per column."""
    return profile_columns(df, columns, **options).select(
        "column_name", F.to_json(F.struct("*")).alias("profile")
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram with empty bins kept; the last bin includes its right edge.

    A table without values yields no rows; a single value is centred in a range of width one.
    """
    value = F.col(column).cast("double")
    present = df.filter(value.isNotNull()).select(value.alias("v"))
    lo, hi = F.min("v"), F.max("v")
    flat = lo == hi
    edges = present.agg(
        F.struct(
            F.when(flat, lo - 0.5).otherwise(lo).alias("lo"),
            F.when(flat, hi + 0.5).otherwise(hi).alias("hi"),
        ).alias("e")
    )
    low, high = edges.scalar().getField("lo"), edges.scalar().getField("hi")
    slot = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counted = present.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    every_bin = edges.filter(F.col("e.lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "e.*"
    )
    step = (F.col("hi") - F.col("lo")) / bins
    return every_bin.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("left_edge"),
        F.when(F.col("bin") == bins - 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * step)
        .alias("right_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("num_rows"),
    )


def freedman_diaconis(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles and the bin count ``ceil((max - min) / (2 IQR n^(-1/3)))``."""
    q1, q3 = exact_quantiles(df, column, [0.25, 0.75])
    value = F.col(column).cast("double")
    width = 2 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n"), F.lit(-1.0 / 3))
    stats = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return stats.select(
        F.col("n").alias("num_values"),
        F.lit(q1).cast("double").alias("q1"),
        F.lit(q3).cast("double").alias("q3"),
        "lo",
        "hi",
        "n",
    ).select(
        "num_values", "q1", "q3",
        F.when(width > 0, F.ceil((F.col("hi") - F.col("lo")) / width)).otherwise(F.lit(1)).cast("bigint").alias("bins"),
    )


def histogram_auto(df: DataFrame, column: str) -> DataFrame:
    """A histogram with the Freedman-Diaconis number of bins."""
    row = freedman_diaconis(df, column).first()
    return histogram(df, column, max(int(row["bins"]), 1))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample standard deviation, min and max, one row per column."""
    columns = list(columns or numeric_columns(df))
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one_row = df.agg(
        F.count("*").alias("rows"),
        *[
            (fn(F.col(c)) if p == "n" else fn(F.col(c).cast("double"))).alias(f"{p}_{i}")
            for i, c in enumerate(columns)
            for p, fn in parts.items()
        ],
    )
    fields = {"num_values": "n", "mean": "mean", "stddev": "std", "min_value": "min", "max_value": "max"}
    return _rows_from_struct(one_row, columns, fields).drop("rows")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The Pearson correlation of every pair of columns, over the rows that have both.

    Sums of products are matrices per task, so a table of hundreds of columns is no problem. NULL
    where fewer than two rows have both columns.
    """
    columns = list(columns)
    found = pairwise_correlations(df, columns)
    cells = [(a, b, None if found.mask[i, j] else float(found.data[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(cells, "column_a string, column_b string, correlation double")


def measure_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each measure as long rows, with the amount formatted in pounds."""
    one_row = df.agg(*[F.avg(c).alias(c) for c in columns])
    return one_row.unpivot([], list(columns), "measure", "mean_price").select(
        "measure",
        F.round("mean_price", 2).alias("mean_price"),
        F.concat(F.lit("£"), F.format_number("mean_price", 2)).alias("mean_price_text"),
    )


def nan_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: NaN, infinite and valid cells; mean, population std, min, max without NaN."""
    one_row_parts: list[Column] = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        # NaN counts as missing; an infinity is a number.
        known = F.when(~F.isnan(v), v)
        finite = F.when(F.abs(known) != float("inf"), known)
        one_row_parts += [
            F.count_if(F.isnan(v)).alias(f"nan_{i}"),
            F.count_if(F.abs(v) == float("inf")).alias(f"inf_{i}"),
            F.count(finite).alias(f"ok_{i}"),
            F.avg(known).alias(f"mean_{i}"),
            F.stddev_pop(known).alias(f"std_{i}"),
            F.min(known).alias(f"min_{i}"),
            F.max(known).alias(f"max_{i}"),
        ]
    fields = {
        "nan_cells": "nan", "inf_cells": "inf", "valid_cells": "ok", "mean": "mean",
        "stddev": "std", "min_value": "min", "max_value": "max",
    }
    return _rows_from_struct(df.agg(*one_row_parts), list(columns), fields).withColumnRenamed(
        "rows", "num_rows"
    )


def compare_tables(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Category frequencies of two tables side by side, for the string columns of the first.

    Rows: (column, value, rows and share in each table, difference of the shares).
    """
    columns = string_columns(original)

    def shares(df: DataFrame, tag: str) -> DataFrame:
        total = df.agg(F.count("*").alias("n")).scalar()
        return value_counts(df, columns).select(
            "column_name",
            "value",
            F.col("num_rows").alias(f"{tag}_rows"),
            (F.col("num_rows") / total).alias(f"{tag}_share"),
        )

    a, b = shares(original, "original").alias("a"), shares(synthetic, "synthetic").alias("b")
    same = (F.col("a.column_name") == F.col("b.column_name")) & F.col("a.value").eqNullSafe(F.col("b.value"))
    share_a = F.coalesce("original_share", F.lit(0.0))
    share_b = F.coalesce("synthetic_share", F.lit(0.0))
    return a.join(b, same, "full").select(
        F.coalesce("a.column_name", "b.column_name").alias("column_name"),
        F.coalesce("a.value", "b.value").alias("value"),
        F.coalesce("original_rows", F.lit(0)).cast("bigint").alias("original_rows"),
        F.coalesce("synthetic_rows", F.lit(0)).cast("bigint").alias("synthetic_rows"),
        F.round(share_b - share_a, 6).alias("share_difference"),
    )


def compare_numbers(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The descriptive statistics of two tables, stacked with a tag."""
    tagged = [
        describe_numeric(df, columns).withColumn("dataset", F.lit(tag))
        for tag, df in (("original", original), ("synthetic", synthetic))
    ]
    return reduce(DataFrame.unionByName, tagged)


def table_shapes(**tables: DataFrame) -> DataFrame:
    """Rows and columns of each named table."""
    parts = [
        df.agg(F.count("*").alias("num_rows")).select(
            F.lit(name).alias("dataset"), "num_rows", F.lit(len(df.columns)).cast("bigint").alias("num_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
