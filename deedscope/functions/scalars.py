"""Scalar functions of the ledger and index programs, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda would repeat it per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pounds(amount: Column | str, decimals: int = 2) -> Column:
    """``£1,234.50``."""
    return F.concat(F.lit("£"), F.format_number(_c(amount), decimals))


def share_line(name: Column | str, percent: Column | str) -> Column:
    """One report line: name, tab, percentage with its sign."""
    return F.concat(_c(name), F.lit("\t"), _c(percent).cast("string"), F.lit("%"))


def year_month(date: Column | str) -> Column:
    """The integer yyyymm. It orders months but is not linear in time."""
    return F.year(_c(date)) * 100 + F.month(_c(date))


def month_index(date: Column | str, origin: Column | str) -> Column:
    """Whole months since ``origin``; linear in time."""
    d, o = _c(date), _c(origin)
    return (F.year(d) - F.year(o)) * 12 + F.month(d) - F.month(o)


def month_starts(first: Column, periods: int) -> Column:
    """An array of ``periods`` consecutive month starts."""
    return F.sequence(first, F.add_months(first, periods - 1), F.expr("interval 1 month"))


def parse_date(text: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """A date, or NULL where the text does not follow the pattern."""
    return F.try_to_date(_c(text), pattern)


def percent_of(part: Column, whole: Column, decimals: int = 2) -> Column:
    return F.round(part / whole * 100, decimals)


def map_values(value: Column | str, mapping: Mapping) -> Column:
    """Replace listed codes by their labels; other values stay, as text."""
    column = _c(value)
    if not mapping:
        return column.cast("string")
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column.cast("string"))


def clip(value: Column | str, low, high) -> Column:
    """Limit a value to a range; NULL stays NULL."""
    column = _c(value)
    return F.when(column.isNotNull(), F.greatest(F.lit(low), F.least(column, F.lit(high))))


def lorentzian(x: Column | str, peaks: list[tuple[float, float, float]]) -> Column:
    """Sum of peaks, each given as (height, centre, half width)."""
    column = _c(x).cast("double")
    terms = [
        F.lit(float(h)) * float(w) ** 2 / ((column - float(c)) * (column - float(c)) + float(w) ** 2)
        for h, c, w in peaks
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def scale_array(values: Column | str, divisor: float) -> Column:
    return F.transform(_c(values), lambda x: x / F.lit(divisor))


def element_or_null(values: Column | str, index: int) -> Column:
    """The element at a zero-based index, NULL outside the array."""
    if index < 0:
        raise ValueError("index counts from zero")
    return F.try_element_at(_c(values), F.lit(index + 1))


def square(value: Column | str) -> Column:
    """The square of a whole number, wide enough not to overflow a bigint."""
    wide = _c(value).cast("decimal(19,0)")
    return wide * wide


def matches_ignoring_case(text: Column | str, pattern: str) -> Column:
    return _c(text).rlike(f"(?i){pattern}")


def holds_keyword(text: Column | str, keyword: str) -> Column:
    """True where the text holds the keyword in any letter case."""
    return F.contains(F.lower(_c(text)), F.lit(keyword.lower()))


# --- long text -------------------------------------------------------------------------------


def words(text: Column | str) -> Column:
    """The whitespace separated words; an empty array for blank text."""
    # Java's \s leaves out the non-ASCII blanks, which the embedded flag adds.
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != "")


def word_chunks(text: Column | str, size: int = 512) -> Column:
    """The whole text as consecutive chunks of ``size`` words, joined by one blank."""

    def cut(tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens), F.lit(size))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " "))
        return F.when(F.size(tokens) > 0, pieces).otherwise(F.array().cast("array<string>"))

    return _let(words(text), cut)


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) that any engine gets from the same parts: 52 bits of the md5 of their text."""
    digest = F.md5(F.encode(F.concat_ws("|", *[p.cast("string") for p in parts]), "UTF-8"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
