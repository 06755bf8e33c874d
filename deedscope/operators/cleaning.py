"""Filters and clean-up of wide string tables."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedscope.functions.scalars import hashed_unit, map_values

# --- filters ---------------------------------------------------------------------------------


def drop_rogue(df: DataFrame, column: str, rogue: str) -> DataFrame:
    """Keep rows whose value differs from ``rogue``; NULL is not known to differ and goes too."""
    return df.filter(F.col(column) != rogue)


def in_period(
    df: DataFrame, area_column: str, area: str, date_column: str,
    start: datetime.date, end: datetime.date, required: Sequence[str] = (),
) -> DataFrame:
    """Rows of one area within a period, with the required columns present."""
    keep = (F.col(area_column) == area) & F.col(date_column).between(start, end)
    for column in required:
        keep = keep & F.col(column).isNotNull()
    return df.filter(keep)


def in_price_band(
    df: DataFrame, county: str, district: str, low: float, high: float, price_column: str = "price_paid"
) -> DataFrame:
    return df.filter(
        (F.col("county") == county)
        & (F.col("district") == district)
        & F.col(price_column).between(low, high)
    )


def without_listed(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    """Drop listed keys, and NULL keys with them; a long list comes as a DataFrame."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(column)).distinct()
        return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")
    return df.filter(~F.col(column).isin(list(values)))


def only_listed(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(column)).distinct()
        return df.join(keys, column, "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def without_substring(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(~F.contains(F.col(column), F.lit(text)))


def with_value(df: DataFrame, column: str, sentinel: str = "NULL") -> DataFrame:
    """Rows with a value; the sentinel text counts as missing."""
    return df.filter(F.coalesce(F.col(column), F.lit(sentinel)) != sentinel)


# --- whole-table clean-up ----------------------------------------------------------------------


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# The punctuation that is stripped from text.
PUNCTUATION = ".,;:!?()[]"


def clean_strings(df: DataFrame, missing: str = "unknown") -> DataFrame:
    """Strip punctuation, lower and trim every string column, then fill its NULLs.

    Empty strings stay empty.
    """
    texts = set(string_columns(df))
    return df.select(
        *[
            F.coalesce(F.trim(F.lower(F.translate(c, PUNCTUATION, ""))), F.lit(missing)).alias(c)
            if c in texts
            else F.col(c)
            for c in df.columns
        ]
    )


# What each character of a column name becomes.
NAME_REPLACEMENTS = {
    " ": "_", ",": "", ".": "", "(": "", ")": "", "/": "_", "-": "_", "&": "and",
    "%": "percent", "#": "number", "@": "at", "!": "", "?": "", ":": "", ";": "",
}


def clean_name(name: str) -> str:
    return name.translate(str.maketrans(NAME_REPLACEMENTS))


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to clean names; two that would become one are an error."""
    names = [clean_name(c) for c in df.columns]
    seen = {n for n in names if [x.lower() for x in names].count(n.lower()) > 1}
    if seen:
        raise ValueError(f"column names collide after cleaning: {sorted(seen)}")
    return df.toDF(*names)


# The address rules, applied in order after lowering.
ADDRESS_RULES = [
    (r"st[\. ]?helier", "St Helier"),
    (r"esplandade|esplanande|esplande|esplanade", "Esplanade"),
    (r"[\.,]", ""),
]


def standard_address(address: Column | str, rules=ADDRESS_RULES) -> Column:
    """The address lowered, with each rule's pattern replaced."""
    result = F.lower(F.col(address) if isinstance(address, str) else address)
    for pattern, replacement in rules:
        result = F.regexp_replace(result, pattern, replacement)
    return result


def non_null_columns(df: DataFrame) -> list[str]:
    """Columns with at least one value, found in one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c] > 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Keep the columns that are not entirely NULL, with their types."""
    return df.select(*non_null_columns(df))


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def tidy_ledger(
    df: DataFrame, *, tenure_column: str = "tenure", rogue: str = "93347",
    casts: Mapping[str, str] | None = None, drop: Sequence[str] = (),
) -> DataFrame:
    """Ledger clean-up: rogue tenures out, casts that turn bad values to NULL, unused columns out."""
    kept = drop_rogue(df, tenure_column, rogue).drop(*drop)
    return kept.withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items()})


def _is_float(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def _finite(df: DataFrame, column: str) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    if not _is_float(df, column):
        return F.col(column)
    value = F.col(column)
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def drop_not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn NaN and infinities to NULL, then drop rows with a missing value in ``columns``."""
    return df.withColumns({c: _finite(df, c) for c in columns}).dropna(subset=list(columns))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every listed column as double, NULL where it is no number; incomplete rows are dropped."""
    cast = df.select(*[F.col(c).cast("string").try_cast("double").alias(c) for c in columns])
    return drop_not_finite(cast, list(columns))


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def fill_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing numbers with their column's mean, computed in one pass for all columns."""
    means = df.agg(*[F.avg(_finite(df, c)).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(_finite(df, c), F.lit(means[c])) for c in columns})


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Exactly the columns of ``schema``: cast, in its order; an absent column is an error."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    absent = [f.name for f in target.fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"columns missing: {absent}")
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in target.fields])


def decode_table(
    df: DataFrame, types: Mapping[str, str], labels: Mapping[str, Mapping] | None = None
) -> DataFrame:
    """Give an encoded table its labels and target types back; unlisted columns stay."""
    labels = labels or {}

    def decoded(column: str) -> Column:
        target = types.get(column)
        if target is None:
            return F.col(column)
        if column in labels:
            return map_values(column, labels[column])
        if target == "date":
            return F.try_to_date(F.col(column).cast("string"), "yyyy-MM-dd")
        return F.col(column).try_cast(target)

    return df.select(*[decoded(c).alias(c) for c in df.columns])


def blank_share(df: DataFrame, column: str, key: Column, share: float, seed: int = 42) -> DataFrame:
    """Blank a share of a column's values; which ones depends only on the key and the seed."""
    return df.withColumn(column, F.when(hashed_unit(F.lit(seed), key) >= share, F.col(column)))
