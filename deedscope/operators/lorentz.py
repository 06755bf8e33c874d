"""Lorentzian curve fits for many series at once.

Points are summed per key and x beforehand, with their number as weight, so a series with a third
of all rows is no larger than its distinct x values. Those of a series are one array, and the
whole Levenberg-Marquardt of a batch of series is one fold over their arrays, in one job. A series
with more distinct x values than an array should hold is fitted in rounds instead, where one
iteration is one aggregation of the normal equations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.functions.scalars import _let
from deedscope.plans.lineage import cut_lineage
from deedscope.plans.sizing import has_at_most

_PARAMETERS = ["h", "c", "w"]
_SUMS = ["s", "hh", "hc", "hw", "cc", "cw", "ww", "rh", "rc", "rw"]


def _equations() -> list[Column]:
    """Squared error and normal equations of a point at the trial parameters."""
    n, h, c, w = F.col("n"), F.col("trial.h"), F.col("trial.c"), F.col("trial.w")
    d = F.col("x") - c
    q = d * d + w * w
    residual = F.col("y") - h * w * w / q
    slope = {"h": w * w / q, "c": 2 * h * w * w * d / (q * q), "w": 2 * h * w * d * d / (q * q)}
    # Points with equal x differ from their mean by an amount no parameter changes.
    return [
        F.sum(n * residual * residual).alias("s"),
        *[F.sum(n * slope[a] * slope[b]).alias(a + b) for a, b in ("hh", "hc", "hw", "cc", "cw", "ww")],
        *[F.sum(n * slope[a] * residual).alias("r" + a) for a in _PARAMETERS],
    ]


def _step(best: Column, damping: Column) -> Column:
    """The trial that follows from a fit's equations: Cramer's rule on the damped system."""

    def e(name: str) -> Column:
        return best.getField(name)

    grow = 1 + damping
    a, b, c = e("hh") * grow, e("hc"), e("hw")
    d, f, g = e("cc") * grow, e("cw"), e("ww") * grow
    x, y, z = e("rh"), e("rc"), e("rw")
    det = a * (d * g - f * f) - b * (b * g - f * c) + c * (b * f - d * c)
    dh = x * (d * g - f * f) - b * (y * g - f * z) + c * (y * f - d * z)
    dc = a * (y * g - f * z) - x * (b * g - f * c) + c * (b * z - y * c)
    dw = a * (d * z - y * f) - b * (b * z - y * c) + x * (b * f - d * c)
    usable = (det != 0) & ~F.isnan(det)

    def moved(name: str, numerator: Column) -> Column:
        step = F.when(usable, numerator / det).otherwise(0.0)
        return (e(name) + step).alias(name)

    return F.struct(moved("h", dh), moved("c", dc), moved("w", dw))


# Series of a block of the fold, times the points of its longest one.
_BLOCK_CELLS = 1 << 20
# Tenfold widenings of the width's bound, from ten ranges to a million.
_WIDENINGS = 5


def _normal(x: np.ndarray, n: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared error, slopes against residuals, and slope products of each series (a row each)."""
    h, c, w = (at[:, i : i + 1] for i in range(3))
    d = x - c
    q = d * d + w * w
    q[q == 0] = 1.0
    residual = y - h * w * w / q
    slopes = np.stack([w * w / q, 2 * h * w * w * d / (q * q), 2 * h * w * d * d / (q * q)], axis=2)
    weighted = slopes * n[:, :, None]
    return (n * residual * residual).sum(axis=1), (weighted * residual[:, :, None]).sum(axis=1), slopes.transpose(0, 2, 1) @ weighted


def _fold(x: np.ndarray, n: np.ndarray, y: np.ndarray, iterations: int, tolerance: float, reach: float) -> np.ndarray:
    """Levenberg-Marquardt on all series of a block: height, centre, width, error, error of the start.

    ``n`` is 0 where a series has no further points. A series goes on until no slope is left along
    its residuals, as a cosine of ``tolerance`` or less. The centre stays within ``reach`` ranges of
    the points' middle and the width below ten of them; a parameter that would leave is held there.
    A series held by the width's bound goes on from there with ten times the width, again and again
    while that lowers its error: points that dip in the middle have the mean as their limit.
    """
    used = n > 0
    low, high = np.where(used, x, np.inf).min(axis=1), np.where(used, x, -np.inf).max(axis=1)
    span, middle = np.where(high > low, high - low, 1.0), (low + high) / 2
    least = np.stack([np.full(len(x), -np.inf), middle - reach * span, -10 * span], axis=1)
    most = np.stack([np.full(len(x), np.inf), middle + reach * span, 10 * span], axis=1)
    top = np.where(used, y, -np.inf).argmax(axis=1)
    rows = np.arange(len(x))
    best = np.stack([y[rows, top], x[rows, top], np.where(high > low, span / 6, 1.0)], axis=1)
    start = _normal(x, n, y, best)[0]
    error = _descend(x, n, y, best, least, most, iterations, tolerance)
    wider = rows
    for _ in range(_WIDENINGS):
        wider = wider[(np.abs(best[wider, 2]) >= most[wider, 2]) & (error[wider] > 0)]
        if not len(wider):
            break
        least[wider, 2] *= 10
        most[wider, 2] *= 10
        moved = best[wider]
        found = _descend(x[wider], n[wider], y[wider], moved, least[wider], most[wider], iterations, tolerance)
        gain = error[wider] - found
        best[wider], error[wider] = moved, found
        # A curve ten times as wide bends a hundredth as much: what is left to gain is less still.
        wider = wider[gain > 1e-6 * found]
    inside = (best[:, 1:] > least[:, 1:]) & (best[:, 1:] < most[:, 1:])
    return np.column_stack([best, error, start, ~inside.all(axis=1)])


def _descend(
    x: np.ndarray, n: np.ndarray, y: np.ndarray, best: np.ndarray, least: np.ndarray, most: np.ndarray, iterations: int, tolerance: float
) -> np.ndarray:
    """Move ``best`` (height, centre, width of each series) down to the least error within bounds; returns the errors."""
    error, along, products = _normal(x, n, y, best)
    damping, going = np.full(len(x), 0.01), np.arange(len(x))
    for _ in range(iterations):
        at, pull = best[going], along[going]
        held = ((at <= least[going]) & (pull < 0)) | ((at >= most[going]) & (pull > 0))
        pull = np.where(held, 0.0, pull)
        scale = np.sqrt(np.maximum(np.diagonal(products[going], axis1=1, axis2=2), 0.0))
        scale[scale == 0] = 1.0
        steep = np.abs(pull) / (scale * np.sqrt(np.maximum(error[going], 1e-300))[:, None])
        open_ = (steep.max(axis=1) > tolerance) & (error[going] > 0) & (damping[going] < 1e12)
        going, scale, pull, held, at = going[open_], scale[open_], pull[open_], held[open_], at[open_]
        if not len(going):
            break
        # In units of the slopes' lengths the system is a correlation matrix, and damping keeps it regular.
        system = products[going] / (scale[:, :, None] * scale[:, None, :])
        system[held[:, :, None] | held[:, None, :]] = 0.0
        system += (damping[going, None] + held)[:, :, None] * np.eye(3)
        step = np.linalg.solve(system, (pull / scale)[:, :, None])[:, :, 0] / scale
        trial = np.clip(at + step, least[going], most[going])
        found = _normal(x[going], n[going], y[going], trial)
        better = found[0] < error[going]
        kept = going[better]
        best[kept], error[kept], along[kept], products[kept] = trial[better], *[part[better] for part in found]
        damping[going] = np.where(better, np.maximum(damping[going] / 5, 1e-9), damping[going] * 4)
    return error


def _fit_batch(xs: pd.Series, ns: pd.Series, ys: pd.Series, iterations: int, tolerance: float, reach: float) -> np.ndarray:
    """All series of a batch, those of like length together."""
    sizes = np.array([len(v) for v in xs])
    found, order, at = np.empty((len(xs), 6)), np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * sizes[order[to]] <= _BLOCK_CELLS:
            to += 1
        some, longest = order[at:to], sizes[order[to - 1]]
        block = np.zeros((3, len(some), longest))
        for i, row in enumerate(some):
            for j, values in enumerate((xs, ns, ys)):
                block[j, i, : sizes[row]] = values.iloc[row]
        found[some], at = _fold(*block, iterations, tolerance, reach), to
    return found


_FIT = "height double, centre double, half_width double, amplitude double, squared_error double, start_error double, at_bound boolean"


def fit_lorentzian(
    df: DataFrame, keys: Sequence[str], x: str, y: str, *, iterations: int = 500, tolerance: float = 1e-8,
    reach: float = 1.0, max_points: int = 200_000,
) -> DataFrame:
    """Height, centre, half width and amplitude of one peak per key, with the squared error.

    ``start_error`` is that of the first guess: the highest point, a third of the range wide. Points
    without a peak would push its centre or width to infinity: the centre stays within ``reach``
    ranges of their middle, the half width within ten, or as many more (to a million) as lower the
    error, and ``at_bound`` tells where that decided.
    Series of more than ``max_points`` distinct x values, if there are any, are fitted in rounds.
    Points without x or y count for nothing; a key without points has no row.
    """
    value, at = F.col(y).cast("double"), F.col(x).cast("double")
    points = cut_lineage(
        df.filter(value.isNotNull() & at.isNotNull())
        .groupBy(*keys, at.alias("x"))
        .agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("y"))
    )
    long = points.groupBy(*keys).count().filter(F.col("count") > max_points).select(*keys)
    some_long = not long.isEmpty()
    short = points
    if some_long:
        on = [F.col(f"p.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
        short = points.alias("p").join(long.alias("l"), on, "left_anti")

    def fit(xs: pd.Series, ns: pd.Series, ys: pd.Series) -> pd.DataFrame:
        h, c, w, error, start, bound = _fit_batch(xs, ns, ys, iterations, tolerance, reach).T
        # The sign of the width is arbitrary: only its square enters the curve.
        w = np.abs(w)
        columns = [h, c, w, h * w * math.pi, error, start, bound > 0]
        return pd.DataFrame(dict(zip([c.split()[0] for c in _FIT.split(", ")], columns, strict=True)))

    fit.__annotations__ = {"xs": pd.Series, "ns": pd.Series, "ys": pd.Series, "return": pd.DataFrame}
    arrays = short.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "n", "y"))).alias("points"))
    parts = [F.col(f"points.{c}") for c in ("x", "n", "y")]
    fits = arrays.select(*keys, F.pandas_udf(fit, _FIT)(*parts).alias("fit")).select(*keys, "fit.*")
    if not some_long:
        return fits
    rest = points.alias("p").join(long.alias("l"), on, "left_semi")
    return fits.unionByName(_fit_in_rounds(rest, keys, iterations=min(iterations, 60), tolerance=tolerance))


def _fit_in_rounds(
    points: DataFrame, keys: Sequence[str], *, iterations: int = 30, cut_every: int = 3, tolerance: float = 1e-8,
    broadcast_keys: int = 100_000,
) -> DataFrame:
    """The same for (keys, x, n, y) rows, one aggregation an iteration.

    After every ``cut_every`` iterations the parameters are checkpointed, and the fit ends early
    when no key's error fell by more than ``tolerance`` of itself. While the keys are few, as
    counted, the parameters travel to the points; otherwise both are joined by key.
    """
    width = F.max("x") - F.min("x")
    unfitted = "struct<" + ",".join(f"{f}:double" for f in _PARAMETERS + _SUMS) + ">"
    state = cut_lineage(
        points.groupBy(*keys).agg(
            F.struct(
                F.max("y").alias("h"),
                F.max_by("x", "y").alias("c"),
                F.when(width > 0, width / 6).otherwise(1.0).alias("w"),
            ).alias("trial"),
            F.lit(0.01).alias("damping"),
            F.lit(None).cast(unfitted).alias("best"),
            F.lit(None).cast("double").alias("error_before"),
            F.lit(None).cast("double").alias("start"),
        )
    )
    # The number of keys stays the same in every iteration, and with it the size of the state.
    few_keys = has_at_most(state, broadcast_keys)

    # Built once and used in every iteration: they refer to columns by name.
    carried = [F.first(c).alias(c) for c in ("trial", "best", "damping", "error_before", "start")]
    sums = [*_equations(), *carried]
    better = F.col("best").isNull() | (F.col("s") < F.col("best.s"))
    tried = F.struct(*[F.col(f"trial.{p}").alias(p) for p in _PARAMETERS], *_SUMS)
    judged = [
        *[F.col(k) for k in keys],
        F.when(better, tried).otherwise(F.col("best")).alias("best"),
        F.when(better, F.col("damping") / 5)
        .otherwise(F.least(F.col("damping") * 4, F.lit(1e12)))
        .alias("damping"),
        F.col("error_before"),
        F.coalesce("start", "s").alias("start"),
    ]
    next_trial = _let(F.col("best"), lambda b: _step(b, F.col("damping")))
    improving = F.col("error_before").isNull() | (
        F.col("error_before") - F.col("best.s") > tolerance * F.col("error_before")
    )
    for i in range(1, iterations + 1):
        side = F.broadcast(state) if few_keys else state
        summed = points.join(side, list(keys)).groupBy(*keys).agg(*sums)
        state = summed.select(*judged).withColumn("trial", next_trial)
        if i % cut_every == 0 and i < iterations:
            state = cut_lineage(state)
            if state.filter(improving).isEmpty():
                break
            state = state.withColumn("error_before", F.col("best.s"))
    half_width = F.abs("best.w")
    return state.select(
        *keys,
        F.col("best.h").alias("height"),
        F.col("best.c").alias("centre"),
        half_width.alias("half_width"),
        (F.col("best.h") * half_width * math.pi).alias("amplitude"),
        F.col("best.s").alias("squared_error"),
        F.col("start").alias("start_error"),
        F.lit(False).alias("at_bound"),
    )


def fitted_values(df: DataFrame, fits: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """The rows with the value of their series' curve."""
    at = F.col(x).cast("double") - F.col("centre")
    w2 = F.col("half_width") * F.col("half_width")
    best = F.col("height") * w2 / (at * at + w2)
    slim = fits.select(*keys, "height", "centre", "half_width")
    return df.join(slim, list(keys)).withColumn("best_fit", best).drop("height", "centre", "half_width")
