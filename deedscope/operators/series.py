"""Monthly price series: extraction, trends, seasonal forecasts, calendar gaps.

A long series table has the key columns, ``date_taken`` and ``price``. Every fit first sums
the rows per key and month, with their number as weight. That leaves the least-squares result
as it is, shrinks a hot key to one row per month before the shuffle by key, and bounds what a
key's window or group holds by the length of the calendar.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedscope.functions.scalars import hashed_unit, month_starts, year_month
from deedscope.operators.cleaning import in_period
from deedscope.operators.profiling import measure_means
from deedscope.plans.lineage import cut_lineage

# --- extraction --------------------------------------------------------------------------------


def region_series(
    index: DataFrame, region: str, start: datetime.date, end: datetime.date, measures: Sequence[str]
) -> DataFrame:
    """One region's measures within a period, in date order."""
    rows = in_period(index, "region_name", region, "date_taken", start, end, ["average_price"])
    return rows.select("date_taken", *measures, year_month("date_taken").alias("year_month")).orderBy(
        "date_taken"
    )


def values_per_date(df: DataFrame, measures: Sequence[str], date: str = "date_taken") -> DataFrame:
    """How many values each measure has per date."""
    return df.groupBy(date).agg(*[F.count(m).alias(f"{m}_count") for m in measures]).orderBy(date)


def region_report(
    index: DataFrame, region: str, start: datetime.date, end: datetime.date, measures: Sequence[str]
) -> dict[str, DataFrame]:
    series = region_series(index, region, start, end, measures)
    return {
        "series": series,
        "values_per_date": values_per_date(series, measures),
        "means": measure_means(series, measures),
    }


def to_long(index: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per key, date and measure; cells without a price are left out."""
    long = index.select(*keys, "date_taken", *measures).unpivot(
        [*keys, "date_taken"], list(measures), "measure", "price"
    )
    return long.filter(F.col("price").isNotNull())


def in_months(df: DataFrame, start: int, end: int, column: str = "year_month") -> DataFrame:
    """Rows between two yyyymm numbers."""
    return df.filter(F.col(column).between(start, end))


def percent_change(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentage change from the calendar month before."""
    months = monthly(series, keys)
    before = Window.partitionBy(*keys).orderBy("t").rangeBetween(-1, -1)
    previous = F.first("price").over(before)
    return months.select(
        *keys, year_month("date_taken").alias("year_month"),
        ((F.col("price") / previous - 1) * 100).alias("percent_change"),
    ).filter(F.col("percent_change").isNotNull())


# --- months --------------------------------------------------------------------------------------


def _months(date: Column) -> Column:
    """Months since year 0: linear in time, and needs no origin."""
    return F.year(date) * 12 + F.month(date) - 1


def monthly(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and month: ``t``, weight ``n``, mean ``price``, and the month's first day."""
    first_day = F.trunc("date_taken", "month")
    return (
        series.filter(F.col("price").isNotNull())
        .groupBy(*keys, first_day.alias("date_taken"))
        .agg(F.count("price").cast("double").alias("n"), F.avg("price").alias("price"))
        .withColumn("t", _months(F.col("date_taken")))
    )


def _future(horizon: int, first: datetime.date | None) -> Column:
    """The months to forecast: from a fixed month, or from the one after the last of the key."""
    start = F.lit(first) if first else F.add_months("last_date", 1)
    return month_starts(start, horizon)


# --- trends --------------------------------------------------------------------------------------


# Subtracted from the month numbers before they are squared: differences stay small and exact.
_ORIGIN = {"month": 24_000, "year_month": 200_000}
_AXES = {"month": _months, "year_month": year_month}


def linear_trend(
    series: DataFrame, keys: Sequence[str], *, horizon: int = 12, first: datetime.date | None = None,
    axis: str = "month",
) -> DataFrame:
    """Straight-line forecast per key. ``axis`` is "month" (linear time) or "year_month" (yyyymm).

    Scaling the axis before the fit would not change the line, so none is done. A key with one
    month has no line and forecasts NULL.
    """
    return _linear(monthly(series, keys), keys, horizon, first, axis)


def _line(months: DataFrame, keys: Sequence[str], axis: str = "month") -> DataFrame:
    """Slope, intercept (at the axis' origin) and last month per key, each month with its weight."""
    x, n, y = _AXES[axis](F.col("date_taken")) - _ORIGIN[axis], F.col("n"), F.col("price")
    sums = months.groupBy(*keys).agg(
        F.sum("n").alias("w"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"),
        F.sum(n * x * y).alias("xy"), F.max("date_taken").alias("last_date"),
    )
    spread = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(spread > 0, (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / spread)
    return sums.withColumn("slope", slope).select(
        *keys, "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("w")).alias("intercept"), "last_date",
        (F.col("y") / F.col("w")).alias("mean"),
    )


def _linear(months: DataFrame, keys: Sequence[str], horizon: int, first: datetime.date | None, axis: str = "month") -> DataFrame:
    future = _line(months, keys, axis).withColumn("date_taken", F.explode(_future(horizon, first)))
    at = _AXES[axis](F.col("date_taken")) - _ORIGIN[axis]
    return future.select(*keys, "date_taken", (F.col("intercept") + F.col("slope") * at).alias("forecast"))


def _solve(moments: pd.Series, products: pd.Series, months: pd.Series) -> pd.Series:
    """Solve one small symmetric system per row: power sums against product sums.

    A row with fewer months than coefficients has no single solution and yields None.
    """
    if len(months) == 0:
        return pd.Series([], dtype=object)
    m, p = np.stack(moments.to_numpy()), np.stack(products.to_numpy())
    size = p.shape[1]
    known = months.to_numpy() >= size
    matrices = m[known][:, np.add.outer(np.arange(size), np.arange(size))]
    solved = iter(np.linalg.solve(matrices, p[known][..., None])[..., 0])
    return pd.Series([next(solved) if ok else None for ok in known], dtype=object)


def polynomial_trend(
    series: DataFrame, keys: Sequence[str], *, degree: int = 3, horizon: int = 12,
    first: datetime.date | None = None,
) -> DataFrame:
    """Least-squares polynomial forecast per key; NULL where a key has too few months.

    Time is centred and scaled per key to [-1, 1] before the power sums are taken, which keeps
    the small systems well conditioned.
    """
    months = monthly(series, keys)
    per_key = Window.partitionBy(*keys)
    low, high = F.min("t").over(per_key), F.max("t").over(per_key)
    scaled = months.select(
        *keys, "n", "price", "date_taken", "t",
        ((low + high) / 2.0).alias("centre"),
        F.greatest((high - low) / 2.0, F.lit(0.5)).alias("half"),
    ).withColumn("u", (F.col("t") - F.col("centre")) / F.col("half"))

    def power(k: int) -> Column:
        return F.col("n") * F.pow("u", F.lit(float(k)))

    # Same keys as the window, so this aggregate needs no further exchange.
    sums = scaled.groupBy(*keys).agg(
        F.array(*[F.sum(power(k)) for k in range(2 * degree + 1)]).alias("moments"),
        F.array(*[F.sum(power(k) * F.col("price")) for k in range(degree + 1)]).alias("products"),
        F.first("centre").alias("centre"),
        F.first("half").alias("half"),
        F.max("date_taken").alias("last_date"),
        F.count("*").alias("months"),
    )
    solve = F.pandas_udf(_solve, "array<double>")
    fitted = sums.withColumn("beta", solve("moments", "products", "months"))
    future = fitted.withColumn("date_taken", F.explode(_future(horizon, first))).withColumn(
        "u", (_months(F.col("date_taken")) - F.col("centre")) / F.col("half")
    )
    value = F.element_at("beta", degree + 1)
    for k in range(degree, 0, -1):
        value = value * F.col("u") + F.element_at("beta", k)
    return future.select(*keys, "date_taken", value.alias("forecast"))


def seasonal_forecast(
    series: DataFrame, keys: Sequence[str], *, horizon: int = 12, period: int = 12, z: float = 1.96
) -> DataFrame:
    """The newest value of the same season plus the mean change for each period passed since.

    One row for each of ``horizon`` months after the key's last. The season's value is looked up
    by calendar month, so a missing month shifts nothing and drops nothing: an older value stands
    in, and where the season was never seen, the trend line (the mean, if there is no line). The
    interval widens with the square root of the periods passed; it is NULL while no change over
    a period is known twice.
    """
    return _seasonal(monthly(series, keys), keys, horizon, period, z)


def _seasonal(months: DataFrame, keys: Sequence[str], horizon: int, period: int = 12, z: float = 1.96) -> DataFrame:
    same_month = Window.partitionBy(*keys).orderBy("t").rangeBetween(-period, -period)
    changes = months.withColumn("change", F.col("price") - F.first("price").over(same_month))
    stats = changes.groupBy(*keys).agg(
        F.avg("change").alias("drift"), F.stddev_samp("change").alias("spread"), F.max("t").alias("last_t")
    )
    newest = months.groupBy(*keys, (F.col("t") % period).alias("season")).agg(
        F.max("t").alias("seen"), F.max_by("price", "t").alias("price")
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    future = (
        stats.join(_line(months, keys), list(keys))
        .select("*", steps)
        .withColumn("t", F.col("last_t") + F.col("step"))
        .withColumn("season", F.col("t") % period)
        .join(newest, [*keys, "season"], "left")
    )
    on_line = F.coalesce(F.col("intercept") + F.col("slope") * (F.col("t") - _ORIGIN["month"]), F.col("mean"))
    drift = F.coalesce("drift", F.col("slope") * period, F.lit(0.0))
    forecast = F.coalesce(F.col("price") + drift * (F.col("t") - F.col("seen")) / period, on_line)
    passed = F.coalesce((F.col("t") - F.col("seen")) / period, F.ceil(F.col("step") / period))
    reach = z * F.col("spread") * F.sqrt(passed)
    return future.select(
        *keys, F.expr("add_months(trunc(last_date, 'month'), step)").alias("date_taken"),
        forecast.alias("forecast"), (forecast - reach).alias("lower"), (forecast + reach).alias("upper"),
    )


# The smoothing weights tried for level, trend and season; the first of equal ones is taken.
LEVEL_WEIGHTS = [0.05, 0.2, 0.5, 0.8]
TREND_WEIGHTS = [0.0, 0.05, 0.2]
SEASON_WEIGHTS = [0.0, 0.1, 0.4]
SMOOTHING_GRID = [(a, b, c) for a in LEVEL_WEIGHTS for b in TREND_WEIGHTS for c in SEASON_WEIGHTS]
# Series of a block, times its months and the weights tried.
_BLOCK_CELLS = 1 << 20
_SMOOTHED = "level double, trend double, seasons array<double>, alpha double, beta double, gamma double, sse double, errors bigint"


def _smooth(prices: np.ndarray, first_t: np.ndarray, period: int) -> list[np.ndarray]:
    """The last level, trend and seasons of each row of monthly prices, by the weights of least error.

    A row begins with its series' first month; months without a price are NaN, and after the last
    month all are. The first two periods give the start; one-step errors count from the second on.
    """
    n, months = prices.shape
    alpha, beta, gamma = (np.array(w) for w in zip(*SMOOTHING_GRID, strict=True))
    rows, known = np.arange(n), ~np.isnan(prices)
    length = months - known[:, ::-1].argmax(axis=1)
    begin = [prices[:, :period], prices[:, period : 2 * period]]
    many = [(~np.isnan(part)).sum(axis=1) for part in begin]
    means = [np.nansum(part, axis=1) / np.maximum(count, 1) for part, count in zip(begin, many, strict=True)]
    slope = np.where(many[1] > 0, (means[1] - means[0]) / period, 0.0)
    # The first period's mean is the level at its middle.
    half = (period - 1) / 2
    level = np.repeat((means[0] + half * slope)[:, None], len(alpha), axis=1)
    trend = np.repeat(slope[:, None], len(alpha), axis=1)
    seasons = np.zeros((n, len(alpha), period))
    for step in range(min(period, months)):
        gap = prices[:, step] - (means[0] + (step - half) * slope)
        seasons[rows, :, (first_t + step) % period] = np.where(np.isnan(gap), 0.0, gap)[:, None]
    sse, errors = np.zeros_like(level), np.zeros(n, np.int64)
    for step in range(period, months):
        season = (first_t + step) % period
        of_season = seasons[rows, :, season]
        price, seen = prices[:, step, None], known[:, step]
        error = price - (level + trend + of_season)
        risen = alpha * (price - of_season) + (1 - alpha) * (level + trend)
        turned = beta * (risen - level) + (1 - beta) * trend
        shifted = gamma * (price - risen) + (1 - gamma) * of_season
        going = (step < length)[:, None]
        level = np.where(seen[:, None], risen, np.where(going, level + trend, level))
        trend = np.where(seen[:, None], turned, trend)
        seasons[rows, :, season] = np.where(seen[:, None], shifted, of_season)
        sse += np.where(seen[:, None], error * error, 0.0)
        errors += seen
    best = sse.argmin(axis=1)
    return [level[rows, best], trend[rows, best], seasons[rows, best], alpha[best], beta[best], gamma[best], sse[rows, best], errors]


def _smooth_batch(ts: pd.Series, prices: pd.Series, period: int) -> pd.DataFrame:
    """All series of a batch, those of like length together."""
    spans = np.array([t[-1] - t[0] + 1 for t in ts])
    first = np.array([t[0] for t in ts])
    parts, order, at = [], np.argsort(spans, kind="stable"), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * spans[order[to]] * len(SMOOTHING_GRID) <= _BLOCK_CELLS:
            to += 1
        some = order[at:to]
        block = np.full((len(some), int(spans[order[to - 1]])), np.nan)
        for i, row in enumerate(some):
            block[i, np.asarray(ts.iloc[row]) - first[row]] = prices.iloc[row]
        parts.append(_smooth(block, first[some], period))
        at = to
    names = [c.split()[0] for c in _SMOOTHED.split(", ")]
    back = np.argsort(order, kind="stable")
    return pd.DataFrame({name: [v for part in parts for v in part[i]] for i, name in enumerate(names)}).iloc[back]


def smoothed_models(series: DataFrame, keys: Sequence[str], *, period: int = 12) -> DataFrame:
    """Level, trend and seasons of each series after its last month, with the weights they were found by.

    Exponential smoothing with an additive trend and season: a recursion over the ordered months
    of a key, run for every combination of the smoothing weights, of which the one with the
    smallest sum of squared one-step errors stays. A month without a price moves the level along
    the trend. ``sse`` and ``errors`` tell the errors' sum of squares and number.
    """
    return _smoothed(monthly(series, keys), keys, period)


def _smoothed(months: DataFrame, keys: Sequence[str], period: int = 12) -> DataFrame:
    def fit(ts: pd.Series, prices: pd.Series) -> pd.DataFrame:
        return _smooth_batch(ts, prices, period)

    fit.__annotations__ = {"ts": pd.Series, "prices": pd.Series, "return": pd.DataFrame}
    arrays = months.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("t", "price"))).alias("points"), F.max("date_taken").alias("last_date")
    )
    model = F.pandas_udf(fit, _SMOOTHED)(F.col("points.t"), F.col("points.price"))
    return arrays.withColumn("model", model).select(*keys, "last_date", "model.*")


def smoothed_forecast(
    series: DataFrame, keys: Sequence[str], *, horizon: int = 12, period: int = 12, z: float = 1.96
) -> DataFrame:
    """The forecast of :func:`smoothed_models` for each of ``horizon`` months after the key's last.

    The interval is that of the one-step errors, widened by what the level takes over from them;
    it is NULL where a series is too short to have any.
    """
    return _smoothed_ahead(monthly(series, keys), keys, horizon, period, z)


def _smoothed_ahead(months: DataFrame, keys: Sequence[str], horizon: int, period: int = 12, z: float = 1.96) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    future = _smoothed(months, keys, period).select("*", steps)
    season = F.element_at("seasons", (_months(F.col("last_date")) + F.col("step")) % period + 1)
    forecast = F.col("level") + F.col("step") * F.col("trend") + season
    spread = F.when(F.col("errors") > 0, F.sqrt(F.col("sse") / F.col("errors")))
    reach = z * spread * F.sqrt(1 + (F.col("step") - 1) * F.col("alpha") * F.col("alpha"))
    return future.select(
        *keys, F.expr("add_months(trunc(last_date, 'month'), step)").alias("date_taken"),
        forecast.alias("forecast"), (forecast - reach).alias("lower"), (forecast + reach).alias("upper"),
    )


def boosted_trend(
    series: DataFrame, keys: Sequence[str], *, horizon: int = 12, first: datetime.date | None = None,
    trees: int = 100, depth: int = 3, seed: int = 42,
) -> DataFrame:
    """Boosted-tree forecast: one model over all series, from the key's mean and the month.

    A tree cannot use a key's name, so each key is described by its own mean price; the model
    learns the price relative to it. All ``trees`` are fitted on all months of all series.
    """
    return _boosted(cut_lineage(monthly(series, keys)), keys, horizon, first, trees, depth, seed)


def _boosted(
    months: DataFrame, keys: Sequence[str], horizon: int, first: datetime.date | None = None, trees: int = 100,
    depth: int = 3, seed: int = 42,
) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    per_key = Window.partitionBy(*keys)
    rows = months.select(
        *keys, "date_taken", F.col("t").cast("double").alias("t"), "price",
        F.avg("price").over(per_key).alias("level"),
    ).withColumn("relative", F.col("price") / F.col("level"))
    season = F.month("date_taken").cast("double").alias("season")
    assembler = VectorAssembler(inputCols=["t", "season", "level"], outputCol="features")
    # Read by every tree.
    training = cut_lineage(assembler.transform(rows.select("t", season, "level", "relative")))
    model = GBTRegressor(
        featuresCol="features", labelCol="relative", maxIter=trees, maxDepth=depth, seed=seed
    ).fit(training)
    last = rows.groupBy(*keys).agg(F.max("date_taken").alias("last_date"), F.first("level").alias("level"))
    future = last.withColumn("date_taken", F.explode(_future(horizon, first))).withColumn(
        "t", _months(F.col("date_taken")).cast("double")
    )
    scored = model.transform(assembler.transform(future.select("*", season)))
    return scored.select(*keys, "date_taken", (F.col("prediction") * F.col("level")).alias("forecast"))


def combined_forecast(series: DataFrame, keys: Sequence[str], *, horizon: int = 12) -> DataFrame:
    """Linear, boosted and seasonal forecasts side by side with the mean of those that are known.

    Every key has a row for each of the ``horizon`` months after its last. The monthly table is
    computed once and handed to all three. The seasonal one is fitted by smoothing.
    """
    on = [*keys, "date_taken"]
    months = cut_lineage(monthly(series, keys))
    last = months.groupBy(*keys).agg(F.max("date_taken").alias("last_date"))
    calendar = last.select(*keys, F.explode(_future(horizon, None)).alias("date_taken"))
    kinds = ["linear", "boosted", "seasonal"]
    parts = (_linear(months, keys, horizon, None), _boosted(months, keys, horizon), _smoothed_ahead(months, keys, horizon))
    joined = calendar
    for name, part in zip(kinds, parts):
        joined = joined.join(part.select(*on, F.col("forecast").alias(name)), on, "left")
    known = F.filter(F.array(*kinds), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return joined.withColumn("combined", F.when(F.size(known) > 0, total / F.size(known)))


# --- calendar --------------------------------------------------------------------------------------


def calendar_gaps_per_key(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Days without a row between each key's first and last day.

    The days observed are made distinct first; a gap is what lies between one and the next.
    """
    days = df.select(*keys, F.col(date).cast("date").alias(date)).filter(F.col(date).isNotNull()).distinct()
    following = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    spans = days.withColumn("__next", following).filter(F.date_diff("__next", date) > 1)
    between = F.sequence(F.date_add(date, 1), F.date_sub("__next", 1), F.expr("interval 1 day"))
    return spans.select(*keys, F.explode(between).alias(date))


def fill_gaps_per_key(
    df: DataFrame, keys: Sequence[str], date: str, value: str, *, low: float = 67.5, high: float = 72.3, seed: int = 42
) -> DataFrame:
    """Rows of ``df`` and one for each missing day of a key, its value drawn evenly from a range.

    The draw, to one decimal, depends on seed, key and day only.
    """
    unit = hashed_unit(F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col(date))
    drawn = F.round(F.lit(low) + (high - low) * unit, 1)
    observed = df.select(*keys, F.col(date).cast("date").alias(date), F.col(value).cast("double").alias(value), F.lit(False).alias("filled"))
    missing = calendar_gaps_per_key(df, keys, date).select(*keys, date, drawn.alias(value), F.lit(True).alias("filled"))
    return observed.unionByName(missing)


def calendar_gaps(df: DataFrame, date: str, start: datetime.date, end: datetime.date) -> DataFrame:
    """Days of the period without a row."""
    days = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias(date)
    )
    return days.join(df.select(date).distinct(), date, "left_anti")


def fill_gaps(
    df: DataFrame, date: str, value: str, start: datetime.date, end: datetime.date,
    *, low: float = 67.5, high: float = 72.3, seed: int = 42,
) -> DataFrame:
    """Add a row for each missing day, its value drawn evenly from a range, to one decimal.

    The draw depends on the day and the seed only.
    """
    drawn = F.round(F.lit(low) + (high - low) * hashed_unit(F.lit(seed), F.col(date).cast("date")), 1)
    observed = df.select(date, F.col(value).cast("double").alias(value), F.lit(False).alias("filled"))
    missing = calendar_gaps(df, date, start, end).select(
        date, drawn.alias(value), F.lit(True).alias("filled")
    )
    return observed.unionByName(missing)
