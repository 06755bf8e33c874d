"""Sums over all rows that are matrices over the columns: one matrix per task, added by Spark.

An aggregate with an expression for each pair of columns grows with their square, far beyond what
code generation takes. Here a task multiplies whole batches of columns and sends one matrix, cut
into pieces; a piece's sums meet in one task of a second step, and what reaches the driver is one
matrix, as large as the square of the number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE = 1 << 14


def doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def matrix_of(batch: pa.RecordBatch | pa.Table, at: Sequence[int] | None = None) -> np.ndarray:
    """The columns of a batch side by side; NULL becomes NaN."""
    columns = [batch.column(i) for i in (range(batch.num_columns) if at is None else at)]
    out = np.empty((batch.num_rows, len(columns)))
    for i, column in enumerate(columns):
        out[:, i] = column.to_numpy(zero_copy_only=False)
    return out


def sum_of_tasks(df: DataFrame, columns: Sequence[str], step: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum, over all batches of rows, of ``step(values, is_null)``, a vector of ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            nulls = np.empty((batch.num_rows, batch.num_columns), bool)
            for i in range(batch.num_columns):
                nulls[:, i] = batch.column(i).is_null().to_numpy(zero_copy_only=False)
            total += step(matrix_of(batch), nulls)
        yield from _pieces(enumerate(np.split(total, range(_PIECE, size, _PIECE))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = values.values.to_numpy(zero_copy_only=False)
                sums[piece] = sums[piece] + part if piece in sums else part
        yield from _pieces(sums.items())

    schema = "piece int, v array<double>"
    parts = doubles(df, columns).mapInArrow(run, schema)
    n_pieces = max(1, -(-size // _PIECE))
    added = parts.repartition(n_pieces, "piece").mapInArrow(add, schema).toArrow()
    total = np.zeros(size)
    for piece, values in zip(added.column(0).to_pylist(), added.column(1), strict=True):
        part = values.values.to_numpy(zero_copy_only=False)
        total[piece * _PIECE : piece * _PIECE + len(part)] += part
    return total


def _pieces(items) -> Iterator[pa.RecordBatch]:
    for piece, values in items:
        lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), lists], names=["piece", "v"])


def near_values(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """A value of each column: taken off, it keeps squares small, and any value gives the same result."""
    first = matrix_of(doubles(df, columns).limit(100).toArrow().combine_chunks())
    return np.array([next((v for v in column if np.isfinite(v)), 0.0) for column in first.T])


def means_of(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of each column's finite values; 0 and 0 without any."""
    n = len(columns)

    def moments(shift: np.ndarray):
        def step(values: np.ndarray, nulls: np.ndarray) -> np.ndarray:
            good = np.isfinite(values)
            off = np.where(good, values - shift, 0.0)
            return np.concatenate([good.sum(axis=0), off.sum(axis=0), (off * off).sum(axis=0)])

        return step

    shift = near_values(df, columns)
    count, total, squares = np.split(sum_of_tasks(df, columns, moments(shift), 3 * n), 3)
    count = np.maximum(count, 1)
    return shift + total / count, np.sqrt(np.maximum(squares / count - (total / count) ** 2, 0.0))


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson's r of every two columns over the rows that have both.

    NaN where one of them is constant there or holds a value that is not finite; masked (as None
    in the table made of it) where no more than one row has both.
    """
    n = len(columns)
    centre = near_values(df, columns)

    def step(values: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        there = (~nulls & np.isfinite(values)).astype(float)
        off = np.where(there > 0, values - centre, 0.0)
        known = (~nulls).astype(float)
        parts = [there.T @ there, known.T @ known, off.T @ there, (off * off).T @ there, off.T @ off]
        return np.concatenate([p.ravel() for p in parts])

    many, both, x, xx, xy = (p.reshape(n, n) for p in np.split(sum_of_tasks(df, columns, step, 5 * n * n), 5))
    with np.errstate(invalid="ignore", divide="ignore"):
        covariance = xy - x * x.T / many
        variance = np.maximum(xx - x * x / many, 0.0)
        # What is left of a constant column by rounding is no variance.
        variance[variance <= 1e-12 * xx] = 0.0
        r = covariance / np.sqrt(variance * variance.T)
    r[both > many] = np.nan
    return np.ma.masked_array(np.clip(r, -1.0, 1.0), both <= 1)


def quantile_grid(df: DataFrame, columns: Sequence[str], levels: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Each column's values at ``levels`` + 1 even quantiles, and its approximate distinct count."""
    at = [i / levels for i in range(levels + 1)]
    facts = df.agg(
        *[F.percentile_approx(F.col(f"`{c}`").cast("double"), at, 10 * levels).alias(f"q{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)],
    ).first()
    if any(facts[f"q{i}"] is None for i in range(len(columns))):
        return None
    return np.array([facts[f"q{i}"] for i in range(len(columns))], float), np.array([facts[f"n{i}"] for i in range(len(columns))])


def places_in(quantiles: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Twice the place of each value in its column's quantiles; the middle place where it spans several."""
    places = np.empty(values.shape, np.int64)
    for i, grid in enumerate(quantiles):
        places[:, i] = np.searchsorted(grid, values[:, i], side="left") + np.searchsorted(grid, values[:, i], side="right") - 1
    return np.clip(places, 0, 2 * (quantiles.shape[1] - 1))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, in rows without NULL or NaN."""
    complete = doubles(df, columns)
    for c in complete.columns:
        complete = complete.filter(F.col(c).isNotNull() & ~F.isnan(c))
    return complete


def rank_correlations(
    df: DataFrame, columns: Sequence[str], *, levels: int = 1000, grid: tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """Spearman's correlation of every two columns over the complete rows, with ranks to 1 in ``levels``.

    ``grid`` is the :func:`quantile_grid` of the complete rows, if it is known already.
    """
    complete, n = complete_rows(df, columns), len(columns)
    grid = grid or quantile_grid(complete, complete.columns, levels)
    if grid is None:
        return np.full((n, n), np.nan)

    def step(values: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        ranks = places_in(grid[0], values) / levels - 1.0
        return np.concatenate([[len(ranks)], ranks.sum(axis=0), (ranks.T @ ranks).ravel()])

    sums = sum_of_tasks(complete, complete.columns, step, 1 + n + n * n)
    mean = sums[1 : 1 + n] / sums[0]
    covariance = sums[1 + n :].reshape(n, n) / sums[0] - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diagonal(covariance), 0.0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return covariance / np.outer(spread, spread)
