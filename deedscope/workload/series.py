"""Trends, forecasts, curve fits and calendar gaps."""

from __future__ import annotations

import datetime
from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deedscope.functions import scalars
from deedscope.operators import lorentz, series
from deedscope.plans.lineage import cut_lineage
from deedscope.workload.profiles import MEASURES
from deedscope.workload.registry import query
from deedscope.workload.tables import price_index, read, rounded, rounded_sql, with_views

KEYS = ["region_name", "measure"]

_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT region_name, date_taken, '{m}' AS measure, {m} AS price, year(date_taken) * 12 + month(date_taken) - 1 AS t "
    f"FROM price_index WHERE {m} IS NOT NULL" for m in MEASURES
) + ")"


def _with_long(body: str) -> str:
    return with_views(f"WITH {_LONG}{',' if not body.startswith('SELECT') else ''} {body}", "price_index")


def long_series(spark, sf):
    return series.to_long(price_index(spark, sf), ["region_name"], MEASURES)


def _money(df, *columns):
    return df.withColumns({c: rounded(c) for c in columns or ("forecast",)})


@query(
    "monthly_nonnull_counts",
    with_views(
        "SELECT date_taken, " + ", ".join(f"count({m}) AS {m}_count" for m in MEASURES) + " FROM price_index GROUP BY date_taken",
        "price_index",
    ),
)
def monthly_nonnull_counts(spark, sf):
    return series.values_per_date(price_index(spark, sf), MEASURES)


_PERIOD = (datetime.date(1995, 6, 1), datetime.date(2000, 12, 1))
_REGION_SQL = """SELECT date_taken, {measures}, year(date_taken) * 100 + month(date_taken) AS year_month FROM price_index
  WHERE region_name = 'NATION_11' AND average_price IS NOT NULL AND date_taken BETWEEN DATE '1995-06-01' AND DATE '2000-12-01'"""


@query(
    "region_series",
    with_views(_REGION_SQL.format(measures=", ".join(f"{rounded_sql(m)} AS {m}" for m in MEASURES)), "price_index"),
)
def region_series(spark, sf):
    rows = series.region_series(price_index(spark, sf), "NATION_11", *_PERIOD, MEASURES)
    return _money(rows, *MEASURES).withColumn("year_month", F.col("year_month").cast("bigint"))


@query(
    "region_means",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS measure, round(avg({m}), 2) AS mean_price, '£' || format('{{:,.2f}}', avg({m})) AS mean_price_text
            FROM ({_REGION_SQL.format(measures=", ".join(MEASURES))})""" for m in MEASURES
        ),
        "price_index",
    ),
)
def region_means(spark, sf):
    return series.region_report(price_index(spark, sf), "NATION_11", *_PERIOD, MEASURES)["means"]


@query(
    "months_between",
    with_views(
        """SELECT region_name, year(date_taken) * 100 + month(date_taken) AS year_month, sales_volume FROM price_index
        WHERE year(date_taken) * 100 + month(date_taken) BETWEEN 199701 AND 200001""",
        "price_index",
    ),
)
def months_between(spark, sf):
    rows = price_index(spark, sf).select(
        "region_name", scalars.year_month("date_taken").cast("bigint").alias("year_month"), "sales_volume"
    )
    return series.in_months(rows, 199701, 200001)


@query(
    "percent_change",
    _with_long(
        """SELECT region_name, measure, year(date_taken) * 100 + month(date_taken) AS year_month,
          round((price / before - 1) * 100, 6) AS percent_change
        FROM (SELECT *, lag(price) OVER w AS before, lag(t) OVER w AS before_t FROM long
          WINDOW w AS (PARTITION BY region_name, measure ORDER BY t)) WHERE before_t = t - 1"""
    ),
)
def percent_change(spark, sf):
    changes = series.percent_change(long_series(spark, sf), KEYS)
    return changes.select(
        *KEYS, F.col("year_month").cast("bigint").alias("year_month"), F.round("percent_change", 6).alias("percent_change")
    )


_FUTURE = """(SELECT f.*, unnest(generate_series(CAST(last_date + INTERVAL 1 MONTH AS TIMESTAMP),
  CAST(last_date + INTERVAL 12 MONTH AS TIMESTAMP), INTERVAL 1 MONTH))::DATE AS date_taken FROM fitted f)"""


@query(
    "linear_trend",
    _with_long(
        f"""fitted AS (SELECT region_name, measure, regr_slope(price, t) AS slope, regr_intercept(price, t) AS base,
          max(date_taken) AS last_date FROM long GROUP BY 1, 2)
        SELECT region_name, measure, date_taken,
          {rounded_sql("base + slope * (year(date_taken) * 12 + month(date_taken) - 1)")} AS forecast FROM {_FUTURE}"""
    ),
)
def linear_trend(spark, sf):
    return _money(series.linear_trend(long_series(spark, sf), KEYS))


@query(
    "linear_trend_yyyymm",
    _with_long(
        f"""fitted AS (SELECT region_name, measure, regr_slope(price, year(date_taken) * 100 + month(date_taken)) AS slope,
          regr_intercept(price, year(date_taken) * 100 + month(date_taken)) AS base, max(date_taken) AS last_date FROM long GROUP BY 1, 2)
        SELECT region_name, measure, date_taken,
          {rounded_sql("base + slope * (year(date_taken) * 100 + month(date_taken))")} AS forecast FROM {_FUTURE}"""
    ),
)
def linear_trend_yyyymm(spark, sf):
    return _money(series.linear_trend(long_series(spark, sf), KEYS, axis="year_month"))


def _determinant(cells: list[list[str]]) -> str:
    """The determinant of a small matrix of SQL expressions, as the sum over permutations."""
    size = len(cells)
    terms = []
    for p in permutations(range(size)):
        odd = sum(p[i] > p[j] for i in range(size) for j in range(i + 1, size)) % 2
        terms.append(("-" if odd else "+") + "*".join(cells[i][p[i]] for i in range(size)))
    return "(" + "".join(terms) + ")"


def _cubic_sql() -> str:
    moments = [[f"m{i + j}" for j in range(4)] for i in range(4)]
    replaced = [
        [[f"p{i}" if j == k else moments[i][j] for j in range(4)] for i in range(4)] for k in range(4)
    ]
    betas = ", ".join(f"{_determinant(r)} / {_determinant(moments)} AS b{k}" for k, r in enumerate(replaced))
    return f"""scaled AS (SELECT *, (t - (lo + hi) / 2.0::DOUBLE) / greatest((hi - lo) / 2.0::DOUBLE, 0.5) AS u FROM
        (SELECT *, min(t) OVER w AS lo, max(t) OVER w AS hi FROM long WINDOW w AS (PARTITION BY region_name, measure))),
      sums AS (SELECT region_name, measure, any_value(lo) AS lo, any_value(hi) AS hi, max(date_taken) AS last_date, count(*) AS months,
        {", ".join(f"sum(power(u, {k})) AS m{k}" for k in range(7))},
        {", ".join(f"sum(power(u, {k}) * price) AS p{k}" for k in range(4))} FROM scaled GROUP BY 1, 2),
      fitted AS (SELECT region_name, measure, lo, hi, last_date, {betas} FROM (SELECT * REPLACE (CASE WHEN months > 3 THEN m0 END AS m0) FROM sums))
    SELECT region_name, measure, date_taken, {rounded_sql("b0 + b1 * u + b2 * u * u + b3 * u * u * u")} AS forecast FROM
      (SELECT *, (year(date_taken) * 12 + month(date_taken) - 1 - (lo + hi) / 2.0::DOUBLE)
        / greatest((hi - lo) / 2.0::DOUBLE, 0.5) AS u FROM {_FUTURE})"""


@query("cubic_trend", _with_long(_cubic_sql()))
def cubic_trend(spark, sf):
    return _money(series.polynomial_trend(long_series(spark, sf), KEYS))


@query(
    "seasonal_naive",
    _with_long(
        f"""changes AS (SELECT a.*, a.price - b.price AS change FROM long a LEFT JOIN long b
          ON a.region_name = b.region_name AND a.measure = b.measure AND a.t = b.t + 12),
        stats AS (SELECT region_name, measure, avg(change) AS drift, stddev_samp(change) AS spread, max(t) AS last_t,
            max(date_taken) AS last_date, regr_slope(price, t) AS slope, regr_intercept(price, t) AS base, avg(price) AS mean
          FROM changes GROUP BY 1, 2),
        newest AS (SELECT region_name, measure, t % 12 AS season, max(t) AS seen, arg_max(price, t) AS price FROM long GROUP BY 1, 2, 3),
        future AS (SELECT *, last_t + step AS t FROM (SELECT *, unnest(range(1, 13)) AS step FROM stats)),
        told AS (SELECT f.*, coalesce(n.price + coalesce(drift, slope * 12, 0) * (f.t - seen) / 12.0::DOUBLE, base + slope * f.t, mean) AS forecast,
            1.96 * spread * sqrt(coalesce((f.t - seen) / 12.0::DOUBLE, 1)) AS reach
          FROM future f LEFT JOIN newest n ON f.region_name = n.region_name AND f.measure = n.measure AND f.t % 12 = n.season)
        SELECT region_name, measure, CAST(last_date + INTERVAL (step) MONTH AS DATE) AS date_taken,
          {rounded_sql("forecast")} AS forecast, {rounded_sql("forecast - reach")} AS lower, {rounded_sql("forecast + reach")} AS upper
        FROM told"""
    ),
)
def seasonal_naive(spark, sf):
    return _money(series.seasonal_forecast(long_series(spark, sf), KEYS), "forecast", "lower", "upper")


def _smoothing_sql() -> str:
    """The smoothing recursion, for every series and combination of weights, month by month."""
    grid = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(series.SMOOTHING_GRID))
    return f"""grid(g, alpha, beta, gamma) AS (VALUES {grid}),
      spans AS (SELECT region_name, measure, min(t) AS t0, max(t) AS t1, max(date_taken) AS last_date FROM long GROUP BY 1, 2),
      starts AS (SELECT region_name, measure, t0, t1, last_date, avg(price) FILTER (t < t0 + 12) AS m0,
          avg(price) FILTER (t >= t0 + 12 AND t < t0 + 24) AS m1, count(*) FILTER (t >= t0 + 12) AS errors
        FROM long JOIN spans USING (region_name, measure) GROUP BY ALL),
      firsts AS (SELECT region_name, measure, list(coalesce(price - (m0 + (y.t - t0 - 5.5::DOUBLE) * coalesce((m1 - m0) / 12, 0)), 0) ORDER BY s) AS seasons FROM
        (SELECT s.*, m.s FROM starts s, (SELECT unnest(range(12)) AS s) m) x
        LEFT JOIN (SELECT l.region_name, l.measure, l.t % 12 AS s, l.t, price FROM long l JOIN spans p USING (region_name, measure) WHERE l.t < t0 + 12) y
          USING (region_name, measure, s) GROUP BY 1, 2),
      run AS (
        SELECT region_name, measure, g, alpha, beta, gamma, t0 + 11 AS t, t1, m0 + 5.5::DOUBLE * coalesce((m1 - m0) / 12, 0) AS level, coalesce((m1 - m0) / 12, 0) AS trend, seasons, 0.0::DOUBLE AS sse
        FROM starts JOIN firsts USING (region_name, measure), grid
        UNION ALL
        SELECT region_name, measure, g, alpha, beta, gamma, t, t1,
          CASE WHEN price IS NULL THEN level + trend ELSE risen END,
          CASE WHEN price IS NULL THEN trend ELSE beta * (risen - level) + (1 - beta) * trend END,
          CASE WHEN price IS NULL THEN seasons ELSE list_concat(seasons[1:t % 12], [gamma * (price - risen) + (1 - gamma) * season], seasons[t % 12 + 2:]) END,
          CASE WHEN price IS NULL THEN sse ELSE sse + (price - (level + trend + season)) * (price - (level + trend + season)) END
        FROM (SELECT r.* EXCLUDE (t), r.t + 1 AS t, l.price, seasons[(r.t + 1) % 12 + 1] AS season,
            alpha * (l.price - seasons[(r.t + 1) % 12 + 1]) + (1 - alpha) * (level + trend) AS risen
          FROM run r LEFT JOIN long l ON l.region_name = r.region_name AND l.measure = r.measure AND l.t = r.t + 1 WHERE r.t < r.t1)),
      fitted AS (SELECT region_name, measure, last_date, errors, arg_min(struct_pack(level, trend, seasons, alpha, sse), (sse, g)) AS m
        FROM run JOIN starts USING (region_name, measure) WHERE run.t >= run.t1 GROUP BY 1, 2, 3, 4)"""


def _with_recursion(body: str) -> str:
    return _with_long(_smoothing_sql() + body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "smoothed_forecast",
    _with_recursion(
        f""" SELECT region_name, measure, CAST(last_date + INTERVAL (step) MONTH AS DATE) AS date_taken, {rounded_sql("f")} AS forecast,
          {rounded_sql("f - reach")} AS lower, {rounded_sql("f + reach")} AS upper
        FROM (SELECT *, m.level + step * m.trend + m.seasons[(year(last_date) * 12 + month(last_date) - 1 + step) % 12 + 1] AS f,
            1.96 * CASE WHEN errors > 0 THEN sqrt(m.sse / errors) END * sqrt(1 + (step - 1) * m.alpha * m.alpha) AS reach
          FROM (SELECT *, unnest(range(1, 13)) AS step FROM fitted))"""
    ),
)
def smoothed_forecast(spark, sf):
    return _money(series.smoothed_forecast(long_series(spark, sf), KEYS), "forecast", "lower", "upper")


@query(
    "seasonal_errors",
    _with_recursion(
        """, changes AS (SELECT a.region_name, a.measure, a.t, a.price - b.price AS change FROM long a JOIN long b
            ON a.region_name = b.region_name AND a.measure = b.measure AND a.t = b.t + 12),
          off AS (SELECT measure, change - coalesce(avg(change) OVER (PARTITION BY region_name, measure ORDER BY t
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM changes),
          rule AS (SELECT measure, sqrt(avg(e * e)) AS rule_error FROM off GROUP BY 1)
        SELECT measure, count(*) AS num_series, round(sqrt(sum(m.sse) / sum(errors)), 2) AS smoothed_error, round(any_value(rule_error), 2) AS rule_error,
          true AS smaller FROM fitted JOIN rule USING (measure) GROUP BY measure"""
    ),
)
def seasonal_errors(spark, sf):
    """One-step errors of the fitted model, beside those of last year's value and the mean change until then."""
    rows = cut_lineage(long_series(spark, sf))
    ordered = Window.partitionBy(*KEYS).orderBy("t")
    # A price twelve months before is a row with t moved on by twelve.
    months = series.monthly(rows, KEYS).select(*KEYS, "t", "price")
    earlier = months.select(*KEYS, (F.col("t") + 12).alias("t"), F.col("price").alias("before"))
    changes = months.join(earlier, [*KEYS, "t"]).withColumn("change", F.col("price") - F.col("before"))
    until = F.coalesce(F.avg("change").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    off = changes.select("measure", (F.col("change") - until).alias("e"))
    rule = off.groupBy("measure").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rule_error"))
    fitted = series.smoothed_models(rows, KEYS).groupBy("measure").agg(
        F.count("*").alias("num_series"), F.sqrt(F.sum("sse") / F.sum("errors")).alias("smoothed_error")
    )
    return fitted.join(rule, "measure").select(
        "measure", "num_series", F.round("smoothed_error", 2).alias("smoothed_error"), F.round("rule_error", 2).alias("rule_error"),
        (F.col("smoothed_error") < F.col("rule_error")).alias("smaller"),
    )


@query("gbt_trend")
def gbt_trend(spark, sf):
    return series.boosted_trend(long_series(spark, sf), KEYS)


@query(
    "forecast_months",
    _with_long(
        f"""fitted AS (SELECT region_name, measure, max(date_taken) AS last_date FROM long GROUP BY 1, 2)
        SELECT region_name, measure, date_taken, true AS has_linear, true AS has_seasonal, true AS has_boosted, true AS has_combined
        FROM {_FUTURE}"""
    ),
)
def forecast_months(spark, sf):
    """Which months the combined forecast covers, and that no forecaster is missing."""
    found = series.combined_forecast(long_series(spark, sf), KEYS)
    has = [F.col(c).isNotNull().alias(f"has_{c}") for c in ("linear", "seasonal", "boosted", "combined")]
    return found.select(*KEYS, "date_taken", *has)


@query("combined_forecast")
def combined_forecast(spark, sf):
    return series.combined_forecast(long_series(spark, sf), KEYS)


@query(
    "month_calendar",
    with_views(
        """SELECT region_name, unnest(generate_series(max(date_taken)::TIMESTAMP, CAST(max(date_taken) + INTERVAL 11 MONTH AS TIMESTAMP),
          INTERVAL 1 MONTH))::DATE AS month_start FROM price_index GROUP BY region_name""",
        "price_index",
    ),
)
def month_calendar(spark, sf):
    last = price_index(spark, sf).groupBy("region_name").agg(F.max("date_taken").alias("last"))
    return last.select("region_name", F.explode(scalars.month_starts(F.col("last"), 12)).alias("month_start"))


def _order_days(spark, sf):
    """All orders, with their days and the nation they come from."""
    nations = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = read(spark, sf, "orders").join(nations, "o_custkey")
    return orders.select("c_nationkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")


_ORDER_DAYS = "(SELECT c_nationkey, o_orderdate::DATE AS day, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)"
_GAPS_SQL = f"""SELECT c_nationkey, unnest(generate_series(CAST(day + INTERVAL 1 DAY AS TIMESTAMP), CAST(next_day - INTERVAL 1 DAY AS TIMESTAMP), INTERVAL 1 DAY))::DATE AS day
  FROM (SELECT *, lead(day) OVER (PARTITION BY c_nationkey ORDER BY day) AS next_day FROM (SELECT DISTINCT c_nationkey, day FROM {_ORDER_DAYS}))
  WHERE date_diff('day', day, next_day) > 1"""


@query("calendar_gaps", _GAPS_SQL)
def calendar_gaps(spark, sf):
    return series.calendar_gaps_per_key(_order_days(spark, sf), ["c_nationkey"], "day")


@query(
    "filled_days",
    f"""SELECT c_nationkey, true AS filled, count(*) AS num_rows FROM ({_GAPS_SQL}) GROUP BY 1
    UNION ALL SELECT c_nationkey, false, count(*) FROM {_ORDER_DAYS} GROUP BY 1""",
)
def filled_days(spark, sf):
    filled = series.fill_gaps_per_key(_order_days(spark, sf), ["c_nationkey"], "day", "o_totalprice")
    return filled.groupBy("c_nationkey", "filled").agg(F.count("*").alias("num_rows"))


@query(
    "gap_fill",
    f"""SELECT c_nationkey, day, round(67.5::DOUBLE + (72.3::DOUBLE - 67.5::DOUBLE) * (('0x' || substr(md5('42|' || c_nationkey || '|' || day), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE), 1) AS o_totalprice, true AS filled
    FROM ({_GAPS_SQL}) UNION ALL SELECT c_nationkey, day, o_totalprice, false FROM {_ORDER_DAYS}""",
)
def gap_fill(spark, sf):
    return series.fill_gaps_per_key(_order_days(spark, sf), ["c_nationkey"], "day", "o_totalprice")


@query(
    "whole_calendar",
    """SELECT d::DATE AS day FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2005-12-31', INTERVAL 1 DAY)) AS d)
    WHERE d::DATE NOT IN (SELECT o_orderdate::DATE FROM orders)""",
)
def whole_calendar(spark, sf):
    return series.calendar_gaps(_order_days(spark, sf), "day", datetime.date(1990, 1, 1), datetime.date(2005, 12, 31))


def _index_points(spark, sf):
    origin = F.lit(datetime.date(1995, 1, 1))
    return price_index(spark, sf).withColumn("month_no", scalars.month_index("date_taken", origin))


@query("lorentz_fit")
def lorentz_fit(spark, sf):
    points = _index_points(spark, sf)
    return lorentz.fit_lorentzian(points, ["region_name"], "month_no", "average_price")


@query(
    "lorentz_facts",
    with_views(
        """SELECT region_name, count(DISTINCT date_taken) AS num_points, true AS stationary, true AS below_start, true AS below_mean
        FROM price_index WHERE average_price IS NOT NULL GROUP BY region_name""",
        "price_index",
    ),
)
def lorentz_facts(spark, sf):
    """What a least-squares fit must be, computed from the points and the fitted curve alone.

    At the solution the normal equations vanish: the curve's slope by each parameter stands at a
    right angle to the residuals, but for a centre or width that its bound holds. The error is below that of the first guess, and not above that
    of the mean, to which a curve of great width comes as near as one likes.
    """
    points = cut_lineage(_index_points(spark, sf).select("region_name", "month_no", F.col("average_price").alias("y")))
    fits = lorentz.fit_lorentzian(points, ["region_name"], "month_no", "y")
    h, w, d = F.col("height"), F.col("half_width"), F.col("month_no") - F.col("centre")
    q = d * d + w * w
    residual = F.col("y") - h * w * w / q
    slopes = [w * w / q, 2 * h * w * w * d / (q * q), 2 * h * w * d * d / (q * q)]
    cosine = [F.abs(F.sum(g * residual)) / F.sqrt(F.sum(g * g) * F.sum(residual * residual)) for g in slopes]
    return points.filter("y IS NOT NULL").join(fits, "region_name").groupBy("region_name").agg(
        F.count("*").alias("num_points"),
        ((cosine[0] < 1e-5) & ((F.greatest(*cosine) < 1e-5) | F.first("at_bound"))).alias("stationary"),
        (F.sum(residual * residual) <= F.first("start_error")).alias("below_start"),
        (F.sum(residual * residual) <= 1.001 * F.var_pop("y") * F.count("*")).alias("below_mean"),
    )


@query("lorentz_curve")
def lorentz_curve(spark, sf):
    points = _index_points(spark, sf).select("region_name", "month_no", "average_price")
    fits = lorentz.fit_lorentzian(points, ["region_name"], "month_no", "average_price")
    return lorentz.fitted_values(points, fits, ["region_name"], "month_no")
