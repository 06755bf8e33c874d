"""Filling gaps and drawing rows from a low-dimensional linear reconstruction.

A linear autoencoder spans the same subspace as the principal components, so the components
stand in for a trained network. They are found in rounds: gaps are filled from the components of
the round before, given what is known of their row, and the filled rows' covariance gives the next
ones. The covariance is summed over the cluster; only the square of the number of columns reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.operators.cleaning import fill_means
from deedscope.operators.features import Scaling, categories, label_positions, widths_of
from deedscope.operators.gram import complete_rows, matrix_of, means_of, places_in, quantile_grid, sum_of_tasks
from deedscope.operators.profiling import value_counts
from deedscope.plans.lineage import cut_lineage
from deedscope.plans.sizing import broadcast_if_small


def _components(scaled: DataFrame, columns: Sequence[str], k: int):
    assembler = VectorAssembler(inputCols=list(columns), outputCol="__features")
    assembled = assembler.transform(scaled)
    return assembled, PCA(k=k, inputCol="__features", outputCol="__scores").fit(assembled)


def _reconstruct(scores: list[Column], loadings, row: int) -> Column:
    total = F.lit(0.0)
    for j, score in enumerate(scores):
        total = total + score * float(loadings[row, j])
    return total


def reconstruct_missing(
    df: DataFrame, columns: Sequence[str], *, k: int = 2, initial: str = "zero",
    bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Replace missing numbers by their reconstruction from ``k`` components.

    While the components are found, missing cells count as 0 or, with ``initial`` "mean", as
    their column's mean, which draws the components less. ``bounds`` limits a column, such as
    an encoded label, to its known range. Present values are left alone.
    """
    if initial not in ("zero", "mean"):
        raise ValueError("initial is zero or mean")
    columns, bounds = list(columns), bounds or {}
    marked = df.withColumns({f"__was_{c}": F.col(c).cast("double") for c in columns})
    if initial == "mean":
        filled = fill_means(marked.withColumns({c: F.col(c).cast("double") for c in columns}), columns)
    else:
        filled = marked.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    scaling = Scaling(filled, columns)
    assembled, model = _components(scaling.apply(filled), columns, k)
    projected = model.transform(assembled).withColumn("__z", vector_to_array("__scores"))
    loadings = model.pc.toArray()
    scores = [F.element_at("__z", j + 1) for j in range(k)]

    def completed(i: int, column: str) -> Column:
        guess = _reconstruct(scores, loadings, i) * scaling.deviation(column) + scaling.mean(column)
        if column in bounds:
            guess = F.greatest(F.lit(float(bounds[column][0])), F.least(guess, F.lit(float(bounds[column][1]))))
        return F.coalesce(F.col(f"__was_{column}"), guess).alias(column)

    done = {c: completed(i, c) for i, c in enumerate(columns)}
    return projected.select(*[done.get(c, F.col(c)) for c in df.columns])


@dataclass
class Latent:
    """Columns as means and deviations, ``loadings`` on the components, and the variance beyond them."""

    mean: np.ndarray
    deviation: np.ndarray
    loadings: np.ndarray
    rest: float

    def fill(self, values: np.ndarray) -> np.ndarray:
        """The rows with each gap (NaN) as expected from the row's known cells."""
        gaps = np.isnan(values)
        scaled = np.where(gaps, 0.0, (values - self.mean) / self.deviation)
        patterns, of = np.unique(gaps, axis=0, return_inverse=True)
        done = values.copy()
        for at, gap in enumerate(patterns):
            if not gap.any():
                continue
            rows = np.flatnonzero(of.ravel() == at)
            known, wanted = self.loadings[~gap], self.loadings[gap]
            system = known.T @ known + max(self.rest, 1e-9) * np.eye(self.loadings.shape[1])
            scores = np.linalg.solve(system, known.T @ scaled[rows][:, ~gap].T)
            done[np.ix_(rows, gap)] = (wanted @ scores).T * self.deviation[gap] + self.mean[gap]
        return done


def fit_latent(df: DataFrame, columns: Sequence[str], *, k: int = 2, rounds: int = 50, tolerance: float = 1e-2) -> Latent:
    """Components of a table with gaps, in rounds until the filled cells stand still.

    The first round fills means. Each further one is one pass: every gap is filled by the newest
    components and by those before, the rows' covariance is summed for the next ones, and the
    rounds end when the two fillings differ by ``tolerance`` standard deviations or less, as root
    mean square. NaN counts as a gap; a column without values is filled with 0.
    """
    columns, n = list(columns), len(columns)
    mean, deviation = means_of(df, columns)
    before, now = None, Latent(mean, np.where(deviation > 0, deviation, 1.0), np.zeros((n, min(k, n))), 1.0)
    for _ in range(rounds):
        sums = sum_of_tasks(df, columns, _filled_sums(now, before), 3 + n + n * n)
        many, gaps, moved = sums[:3]
        still = before is not None and moved <= tolerance**2 * gaps
        if still or not many:
            break
        off = sums[3 : 3 + n] / many
        covariance = sums[3 + n :].reshape(n, n) / many - np.outer(off, off)
        spread = np.sqrt(np.maximum(np.diagonal(covariance), 0.0))
        spread = np.where(spread > 1e-9, spread, 1.0)
        share, axes = np.linalg.eigh(covariance / np.outer(spread, spread))
        share, axes = np.maximum(share[::-1], 0.0), axes[:, ::-1]
        rest = float(share[k:].mean()) if k < n else 0.0
        loadings = axes[:, :k] * np.sqrt(np.maximum(share[:k] - rest, 0.0))
        before, now = now, Latent(now.mean + off * now.deviation, now.deviation * spread, loadings, rest)
    return now


def _filled_sums(now: Latent, before: Latent | None):
    """Rows, gaps, how far the gaps moved since ``before``, and moments of the filled and scaled rows."""

    def step(values: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        gaps = ~np.isfinite(values)
        values = np.where(gaps, np.nan, values)
        filled = (now.fill(values) - now.mean) / now.deviation
        moved = (filled - (before.fill(values) - now.mean) / now.deviation)[gaps] if before else np.zeros(0)
        counts = [len(values), gaps.sum(), (moved * moved).sum()]
        return np.concatenate([counts, filled.sum(axis=0), (filled.T @ filled).ravel()])

    return step


def reconstruct_iterated(
    df: DataFrame, columns: Sequence[str], *, k: int = 2, rounds: int = 50, tolerance: float = 1e-2,
    bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Replace missing numbers by their reconstruction from :func:`fit_latent`'s ``k`` components.

    ``bounds`` limits a column, such as an encoded label, to its known range. Present values, NaN
    among them, are left alone; the columns come back as double.
    """
    columns, bounds = list(columns), bounds or {}
    found = fit_latent(df, columns, k=k, rounds=rounds, tolerance=tolerance)
    low = np.array([bounds.get(c, (-np.inf, np.inf))[0] for c in columns], float)
    high = np.array([bounds.get(c, (-np.inf, np.inf))[1] for c in columns], float)
    rows = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns})
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix_of(batch, at)
            done = np.clip(found.fill(np.where(np.isfinite(values), values, np.nan)), low, high)
            out = list(batch.columns)
            for i, place in enumerate(at):
                gaps = batch.column(place).is_null().to_numpy(zero_copy_only=False)
                out[place] = pa.array(np.where(gaps, done[:, i], values[:, i]))
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def impute_table(
    df: DataFrame, *, numeric: Sequence[str], text: Sequence[str], k: int = 2, label_above: int = 100,
    initial: str | None = None,
) -> DataFrame:
    """Fill the gaps of numeric and text columns together; the columns stay as they are.

    Text with more than ``label_above`` values is encoded by its place in the alphabet, other
    text by one 0/1 column per value. A missing label is decoded from its reconstructed code,
    limited to the known labels; a missing category is the one whose 0/1 column comes out
    highest. Gaps are filled in rounds, or with ``initial`` (see :func:`reconstruct_missing`) in one.
    """
    counts = cut_lineage(value_counts(df, text))
    widths = widths_of(counts)
    wide = [c for c in text if widths.get(c, 0) > label_above]
    narrow = categories(df, [c for c in text if c not in wide], counts=counts)
    positions = {c: cut_lineage(label_positions(df, c, order="alphabet", counts=counts)) for c in wide}

    encoded = df
    for c in wide:
        codes = positions[c].select(
            F.col("label").alias("__label"), F.col("position").cast("double").alias(f"__code_{c}")
        )
        encoded = encoded.join(
            broadcast_if_small(codes), F.col(c) == F.col("__label"), "left"
        ).drop("__label")
    flags = {c: [f"__flag_{c}_{i}" for i in range(len(values))] for c, values in narrow.items()}
    encoded = encoded.withColumns(
        {
            name: (F.col(c) == value).cast("double")
            for c, values in narrow.items()
            for name, value in zip(flags[c], values)
        }
    )
    inputs = [*numeric, *[f"__code_{c}" for c in wide], *[f for names in flags.values() for f in names]]
    bounds = {f"__code_{c}": (0, widths[c] - 1) for c in wide}
    # The fits below read the encoded rows several times.
    encoded = cut_lineage(encoded)
    if initial is None:
        done = reconstruct_iterated(encoded, inputs, k=k, bounds=bounds)
    else:
        done = reconstruct_missing(encoded, inputs, k=k, initial=initial, bounds=bounds)

    for c in wide:
        labels = positions[c].select(F.col("label").alias("__label"), F.col("position").alias("__position"))
        code = F.col(f"__code_{c}").cast("bigint")
        done = done.join(broadcast_if_small(labels), code == F.col("__position"), "left")
        done = done.withColumn(c, F.coalesce(c, "__label")).drop("__label", "__position")
    for c, values in narrow.items():
        if values:
            scored = F.array(
                *[F.struct(F.col(f).alias("flag"), F.lit(v).alias("value")) for f, v in zip(flags[c], values)]
            )
            done = done.withColumn(c, F.coalesce(F.col(c), F.array_max(scored)["value"]))
    return done.select(*df.columns)


def draw_rows(
    df: DataFrame, columns: Sequence[str], n: int, *, k: int | None = None, seed: int = 42, levels: int = 1000,
    grid: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """``n`` synthetic rows with the columns' own distributions and their rank correlations.

    Each value of the complete rows becomes a normal score by its place in its column. The scores'
    correlations, from ``k`` components or by default all, are those of the drawn scores, which
    the inverse of the column's distribution maps back: no value leaves its column's range. The
    distribution is known at ``levels`` quantiles; between them values are interpolated, but for
    columns with no more distinct values than that. ``grid`` is the :func:`quantile_grid` of the
    complete rows at ``levels``, if it is known already. Returns id and the columns as double.
    """
    columns, size = list(columns), len(columns)
    complete = complete_rows(df, columns)
    grid = grid or quantile_grid(complete, complete.columns, levels)
    if grid is None:
        raise ValueError("no complete row to draw from")
    quantiles, distinct = grid
    interpolated = distinct > levels
    normal = NormalDist()
    inside = lambda p: min(max(p, 0.25 / levels), 1 - 0.25 / levels)
    # The score of each quantile, and of the middle of those a value lies between.
    score = np.array([normal.inv_cdf(inside(i / levels)) for i in range(levels + 1)])
    middles = np.array([normal.inv_cdf(inside(i / 2 / levels)) for i in range(2 * levels + 1)])

    def scores_of(values: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        z = middles[places_in(quantiles, values)]
        return np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])

    sums = sum_of_tasks(complete, complete.columns, scores_of, 1 + size + size * size)
    off = sums[1 : 1 + size] / sums[0]
    covariance = sums[1 + size :].reshape(size, size) / sums[0] - np.outer(off, off)
    spread = np.sqrt(np.maximum(np.diagonal(covariance), 1e-12))
    share, axes = np.linalg.eigh(covariance / np.outer(spread, spread))
    share, axes = np.maximum(share[::-1], 0.0)[: k or size], axes[:, ::-1][:, : k or size]
    loadings = axes * np.sqrt(share)
    own = np.sqrt(np.maximum(1 - (loadings**2).sum(axis=1), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = matrix_of(batch, range(1, batch.num_columns))
            z = drawn[:, : len(share)] @ loadings.T + drawn[:, len(share) :] * own
            out = []
            for i in range(size):
                if interpolated[i]:
                    values = np.interp(z[:, i], score, quantiles[i])
                else:
                    values = quantiles[i][np.clip(np.searchsorted(score, z[:, i]), 0, levels)]
                out.append(pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["id", *columns])

    noise = [F.randn(seed + j).alias(f"z{j}") for j in range(len(share) + size)]
    rows = df.sparkSession.range(n).select("id", *noise)
    return rows.mapInArrow(run, "id long, " + ", ".join(f"`{c}` double" for c in columns))
