"""Profiles of the ledger, the line items and the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from deedscope.operators import cleaning, profiling, reports
from deedscope.plans.lineage import scratch_path
from deedscope.workload.ledger import histogram_sql
from deedscope.workload.registry import query
from deedscope.workload.tables import HIGH_PRICE, PROPERTY_TYPES, price_index, read, registry, with_views

COLUMNS = [
    "title_number", "tenure", "district", "county", "region", "postcode", "multiple_address",
    "price_paid", "proprietor1", "proprietor2", "category", "country", "address1", "date_added",
]
TEXTS = [c for c in COLUMNS if c not in ("price_paid", "date_added")]
CATEGORIES = ["tenure", "district", "county", "country", "category"]
MEASURES = ["average_price", *[f"{k}_price" for k in PROPERTY_TYPES]]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def _nulls_sql(source: str, columns) -> str:
    return _union(
        f"""SELECT '{c}' AS column_name, (count(*) - count({c}))::BIGINT AS null_count,
        round((count(*) - count({c})) / count(*) * 100, 1) AS null_percentage FROM {source}"""
        for c in columns
    )


@query("null_percentages", with_views(_nulls_sql("registry", COLUMNS), "registry"))
def null_percentages(spark, sf):
    return profiling.null_percentages(registry(spark, sf))


@query(
    "missing_summary",
    with_views(
        f"""SELECT count(*) AS num_columns, count(*) FILTER (null_percentage > 0) AS columns_with_null,
          string_agg(column_name, ',' ORDER BY column_name) FILTER (null_percentage > 0) AS names_with_null,
          round(count(*) FILTER (null_percentage = 100) / count(*) * 100, 2) AS null_columns_percentage
        FROM ({_nulls_sql('registry', COLUMNS)})""",
        "registry",
    ),
)
def missing_summary(spark, sf):
    return profiling.missing_summary(registry(spark, sf))


@query(
    "null_distinct",
    with_views(
        _union(
            f"""SELECT '{c}' AS column_name, round((count(*) - count({c})) / count(*) * 100, 1) AS null_percentage,
            count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_count FROM registry"""
            for c in COLUMNS
        ),
        "registry",
    ),
)
def null_distinct(spark, sf):
    return profiling.null_and_distinct(registry(spark, sf))


_TYPES = {"price_paid": "double", "date_added": "date"}


def _profile_sql(c: str) -> str:
    empty = f"count(*) FILTER ({c} IS NULL" + (f" OR {c} = '')" if c in TEXTS else ")")
    distinct = f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    number = c == "price_paid"
    return f"""SELECT '{c}' AS column_name, true AS column_exists, '{_TYPES.get(c, "string")}' AS data_type,
      count(*) AS num_rows, {empty} AS null_count, round({empty} / count(*) * 100, 2) AS null_percentage,
      {distinct} AS distinct_count, round(({distinct} - {empty}) / count(*) * 100, 2) AS distinct_percentage,
      {"min(price_paid)" if number else "NULL::DOUBLE"} AS min_value,
      {"max(price_paid)" if number else "NULL::DOUBLE"} AS max_value,
      {"round(avg(price_paid), 2)" if number else "NULL::DOUBLE"} AS avg_value FROM registry"""


_ABSENT_SQL = """SELECT 'no_such_column', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"""


@query("column_profile", with_views(_union([*map(_profile_sql, COLUMNS), _ABSENT_SQL]), "registry"))
def column_profile(spark, sf):
    return profiling.profile_columns(registry(spark, sf), [*COLUMNS, "no_such_column"]).drop("histogram")


def _edges_sql(source: str, value: str, bins: int) -> str:
    return f"""SELECT h.bin::INT AS bin, round(lo + h.bin * (hi - lo) / {bins}, 6) AS left_edge,
      round(CASE WHEN h.bin = {bins} - 1 THEN hi ELSE lo + (h.bin + 1) * (hi - lo) / {bins} END, 6) AS right_edge, h.num_rows
    FROM ({histogram_sql(source, value, bins)}) h CROSS JOIN
      (SELECT min({value}) AS lo, max({value}) AS hi FROM ({source}))"""


def _rounded_edges(df):
    return df.withColumns({c: F.round(c, 6) for c in ("left_edge", "right_edge")})


def _profile_edges(c: str) -> str:
    return _edges_sql(f"SELECT {c}::DOUBLE AS {c} FROM lineitem", c, 10)


_LINE_NUMBERS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]


@query(
    "profile_histograms",
    _union(
        f"SELECT '{c}' AS column_name, * FROM ({{}})".format(sql)
        for c, sql in ((c, _profile_edges(c)) for c in _LINE_NUMBERS)
    ),
)
def profile_histograms(spark, sf):
    """The histograms of a whole profile: ints, bigints and doubles."""
    profile = profiling.profile_columns(read(spark, sf, "lineitem").select(*_LINE_NUMBERS, "l_returnflag"))
    bins = profile.select("column_name", F.posexplode("histogram").alias("bin", "h")).select("column_name", "bin", "h.*")
    return _rounded_edges(bins)


_MOMENT_SQL = """SELECT '{c}' AS column_name, '{t}' AS data_type, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value,
  round(avg({c}), 2) AS avg_value, count(DISTINCT {c}) AS distinct_count FROM lineitem"""


@query(
    "profile_number_types",
    _union(_MOMENT_SQL.format(c=c, t=t) for c, t in zip(_LINE_NUMBERS, ("bigint", "int", "double", "double"))),
)
def profile_number_types(spark, sf):
    profile = profiling.profile_columns(read(spark, sf, "lineitem").select(*_LINE_NUMBERS))
    return profile.select("column_name", "data_type", "min_value", "max_value", "avg_value", "distinct_count")


@query("hll_profile")
def hll_profile(spark, sf):
    return profiling.profile_columns(registry(spark, sf), approximate=True)


@query(
    "merged_profiles",
    """SELECT year(o_orderdate)::INT AS year, count(*) AS num_rows, count(*) FILTER (o_totalprice IS NULL) AS o_totalprice_nulls,
      count(DISTINCT o_custkey) AS exact, true AS distinct_near, true AS quartiles_near FROM orders GROUP BY 1""",
)
def merged_profiles(spark, sf):
    """Profiles kept per month and merged per year, beside the exact ones: within four standard errors."""
    orders = read(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    path = scratch_path(spark, "profiles")
    profiling.sketch_columns(orders, ["month"], distinct=["o_custkey"], numbers=["o_totalprice"]).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("year", F.substring("month", 1, 4).cast("int"))
    merged = profiling.read_sketches(profiling.merge_sketches(kept, ["year"]), [0.25, 0.5, 0.75]).alias("m")
    price, q = F.col("o_totalprice"), F.col("m.o_totalprice_quantiles")
    exact = orders.select(F.year("o_orderdate").alias("year"), "o_custkey", "o_totalprice")
    counted = exact.groupBy("year").agg(F.count_distinct("o_custkey").alias("exact"))
    # The rank at which a sketched quartile really stands.
    ranks = exact.join(F.broadcast(merged), "year").groupBy("year").agg(
        *[(F.count_if(price <= F.element_at(q, i)) / F.count(price) - i / 4).alias(f"off{i}") for i in (1, 2, 3)]
    )
    near = F.greatest(*[F.abs(f"off{i}") for i in (1, 2, 3)]) < 4 * 0.0175
    return merged.join(counted, "year").join(ranks, "year").select(
        "year", "num_rows", "o_totalprice_nulls", "exact",
        (F.abs(F.col("o_custkey_distinct") - F.col("exact")) <= 4 * 0.016 * F.col("exact")).alias("distinct_near"),
        near.alias("quartiles_near"),
    )


@query(
    "profile_as_json",
    with_views(
        "SELECT column_name, data_type, num_rows, null_count, distinct_count, min_value, avg_value, CASE WHEN data_type = 'double' THEN 10 ELSE -1 END AS bins FROM ("
        + _union(map(_profile_sql, COLUMNS))
        + ")",
        "registry",
    ),
)
def profile_as_json(spark, sf):
    """The JSON documents, read back."""
    documents = profiling.profile_json(registry(spark, sf))
    schema = """column_name string, data_type string, num_rows bigint, null_count bigint, distinct_count bigint,
      min_value double, avg_value double, histogram array<struct<left_edge: double, right_edge: double, num_rows: bigint>>"""
    return documents.select(F.from_json("profile", schema).alias("p")).select(
        *[f"p.{c}" for c in ("column_name", "data_type", "num_rows", "null_count", "distinct_count", "min_value", "avg_value")],
        F.coalesce(F.size("p.histogram"), F.lit(-1)).alias("bins"),
    )


@query("histogram_equal_width", _edges_sql("SELECT l_extendedprice FROM lineitem", "l_extendedprice", 33))
def histogram_equal_width(spark, sf):
    return _rounded_edges(profiling.histogram(read(spark, sf, "lineitem"), "l_extendedprice", 33))


_FD_SQL = """SELECT count(v) AS num_values, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3,
  CAST(ceil((max(v) - min(v)) / (2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) * pow(count(v), -1.0 / 3))) AS BIGINT) AS bins
FROM (SELECT {value} AS v FROM {source})"""


@query("fd_bins", _FD_SQL.format(value="l_extendedprice", source="lineitem"))
def fd_bins(spark, sf):
    result = profiling.freedman_diaconis(read(spark, sf, "lineitem"), "l_extendedprice")
    return result.withColumns({c: F.round(c, 6) for c in ("q1", "q3")})


@query("fd_bins_ledger", with_views(_FD_SQL.format(value="price_paid", source="registry"), "registry"))
def fd_bins_ledger(spark, sf):
    result = profiling.freedman_diaconis(registry(spark, sf), "price_paid")
    return result.withColumns({c: F.round(c, 6) for c in ("q1", "q3")})


@query(
    "histogram_auto",
    f"""WITH f AS ({_FD_SQL.format(value="value", source="events")}), e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
      c AS (SELECT least(floor((value - lo) / (hi - lo) * bins)::BIGINT, bins - 1) AS bin, count(*) AS n FROM events, e, f WHERE value IS NOT NULL GROUP BY 1)
    SELECT b.bin::INT AS bin, round(lo + b.bin * (hi - lo) / bins, 6) AS left_edge,
      round(CASE WHEN b.bin = bins - 1 THEN hi ELSE lo + (b.bin + 1) * (hi - lo) / bins END, 6) AS right_edge, coalesce(n, 0) AS num_rows
    FROM (SELECT unnest(range(bins)) AS bin, bins FROM f) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""",
)
def histogram_auto(spark, sf):
    return _rounded_edges(profiling.histogram_auto(read(spark, sf, "events"), "value"))


def _describe_sql(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS num_values, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS stddev, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value FROM {source}"""


def _rounded_moments(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query("describe_numeric", _union(_describe_sql(c, "lineitem") for c in NUMBERS))
def describe_numeric(spark, sf):
    return _rounded_moments(profiling.describe_numeric(read(spark, sf, "lineitem"), NUMBERS))


@query(
    "category_counts",
    with_views(
        _union(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS num_rows FROM registry GROUP BY {c}" for c in TEXTS),
        "registry",
    ),
)
def category_counts(spark, sf):
    return profiling.value_counts(registry(spark, sf), TEXTS)


_QUALITY_COLUMNS = ["tenure", "country", "category"]


def _quality_sql() -> str:
    parts = []
    for c in _QUALITY_COLUMNS:
        parts.append(
            f"""SELECT '{c}' AS column_name, coalesce(a.v, b.v) AS value, coalesce(a.n, 0) AS original_rows,
              coalesce(b.n, 0) AS synthetic_rows, round(coalesce(b.s, 0.0) - coalesce(a.s, 0.0), 6) AS share_difference
            FROM (SELECT {c} AS v, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM registry) AS s FROM registry GROUP BY 1) a
            FULL JOIN (SELECT {c} AS v, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM registry WHERE price_paid > {HIGH_PRICE}) AS s
                       FROM registry WHERE price_paid > {HIGH_PRICE} GROUP BY 1) b ON a.v IS NOT DISTINCT FROM b.v"""
        )
    return _union(parts)


@query("synthetic_quality", with_views(_quality_sql(), "registry"))
def synthetic_quality(spark, sf):
    rows = registry(spark, sf).select(*_QUALITY_COLUMNS, "price_paid")
    return profiling.compare_tables(rows, rows.filter(F.col("price_paid") > HIGH_PRICE))


@query(
    "quality_numbers",
    with_views(
        f"""SELECT *, 'original' AS dataset FROM ({_describe_sql("price_paid", "registry")})
        UNION ALL SELECT *, 'synthetic' FROM ({_describe_sql("price_paid", f"registry WHERE price_paid > {HIGH_PRICE}")})""",
        "registry",
    ),
)
def quality_numbers(spark, sf):
    rows = registry(spark, sf)
    dear = rows.filter(F.col("price_paid") > HIGH_PRICE)
    return _rounded_moments(profiling.compare_numbers(rows, dear, ["price_paid"]))


@query(
    "quality_shapes",
    with_views(
        f"""SELECT 'original' AS dataset, count(*) AS num_rows, {len(COLUMNS)}::BIGINT AS num_columns FROM registry
        UNION ALL SELECT 'synthetic', count(*), {len(COLUMNS)} FROM registry WHERE price_paid > {HIGH_PRICE}""",
        "registry",
    ),
)
def quality_shapes(spark, sf):
    rows = registry(spark, sf)
    return profiling.table_shapes(original=rows, synthetic=rows.filter(F.col("price_paid") > HIGH_PRICE))


@query(
    "onehot_width",
    with_views(
        _union(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM registry" for c in CATEGORIES)
        + "\nUNION ALL SELECT '(total)', ("
        + " + ".join(f"(SELECT count(DISTINCT {c}) FROM registry)" for c in CATEGORIES)
        + ")",
        "registry",
    ),
)
def onehot_width(spark, sf):
    return profiling.distinct_widths(registry(spark, sf), CATEGORIES)


@query(
    "correlation_matrix",
    _union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) + 0.0 AS correlation FROM lineitem"
        for a in NUMBERS
        for b in NUMBERS
    ),
)
def correlation_matrix(spark, sf):
    result = profiling.correlations(read(spark, sf, "lineitem"), NUMBERS)
    return result.withColumn("correlation", F.round("correlation", 6) + 0.0)


@query(
    "measure_means",
    with_views(
        _union(
            f"""SELECT '{m}' AS measure, round(avg({m}), 2) AS mean_price, '£' || format('{{:,.2f}}', avg({m})) AS mean_price_text
            FROM price_index""" for m in MEASURES
        ),
        "price_index",
    ),
)
def measure_means(spark, sf):
    return profiling.measure_means(price_index(spark, sf), MEASURES)


# Event values with NaN and infinities put in by key.
_NAN_SQL = """(SELECT CASE WHEN event_id % 19 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 23 = 0 THEN 'Infinity'::DOUBLE
  WHEN event_id % 29 <> 0 THEN value END AS value, event_id::DOUBLE AS id, event_type FROM events)"""


def _events_with_nan(spark, sf):
    value = (
        F.when(F.col("event_id") % 19 == 0, float("nan"))
        .when(F.col("event_id") % 23 == 0, float("inf"))
        .when(F.col("event_id") % 29 != 0, F.col("value"))
    )
    events = read(spark, sf, "events")
    return events.select(value.alias("value"), F.col("event_id").cast("double").alias("id"), "event_type")


def _nan_stats_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(*) AS num_rows, count(*) FILTER (isnan({c})) AS nan_cells,
      count(*) FILTER (isinf({c})) AS inf_cells, count(*) FILTER (isfinite({c})) AS valid_cells,
      max({c}) FILTER (NOT isnan({c})) AS max_value, min({c}) FILTER (NOT isnan({c})) AS min_value FROM {_NAN_SQL}"""


@query("nan_stats", _union(map(_nan_stats_sql, ["value", "id"])))
def nan_stats(spark, sf):
    result = profiling.nan_statistics(_events_with_nan(spark, sf), ["value", "id"])
    return result.drop("mean", "stddev")


@query(
    "nan_moments",
    """SELECT 'value' AS column_name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev FROM
    (SELECT CASE WHEN event_id % 19 <> 0 AND event_id % 29 <> 0 THEN value END AS value FROM events)""",
)
def nan_moments(spark, sf):
    value = F.when(F.col("event_id") % 19 == 0, float("nan")).when(F.col("event_id") % 29 != 0, F.col("value"))
    stats = profiling.nan_statistics(read(spark, sf, "events").select(value.alias("value")), ["value"])
    return stats.select("column_name", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


@query(
    "inf_nan_clean",
    f"SELECT id, value, event_type FROM {_NAN_SQL} WHERE isfinite(value)",
)
def inf_nan_clean(spark, sf):
    return cleaning.drop_not_finite(_events_with_nan(spark, sf), ["value"])


@query(
    "fill_missing",
    f"""SELECT id, round(CASE WHEN isfinite(value) THEN value ELSE (SELECT avg(value) FROM {_NAN_SQL} WHERE isfinite(value)) END, 6) AS value,
      CASE WHEN id % 31 = 0 THEN 'unknown' ELSE event_type END AS event_type FROM {_NAN_SQL}""",
)
def fill_missing(spark, sf):
    rows = _events_with_nan(spark, sf).withColumn("event_type", F.when(F.col("id") % 31 != 0, F.col("event_type")))
    filled = cleaning.fill_means(cleaning.fill_constants(rows, {"event_type": "unknown"}), ["value"])
    return filled.withColumn("value", F.round("value", 6))


@query(
    "stddev_pop",
    "SELECT event_type, round(stddev_pop(value), 6) AS stddev FROM events GROUP BY event_type",
)
def stddev_pop(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(F.stddev_pop("value"), 6).alias("stddev"))


@query(
    "explore",
    with_views(
        f"""SELECT 'describe' AS section, column_name AS item, mean AS amount FROM ({_describe_sql("price_paid", "registry")})
        UNION ALL SELECT 'missing', column_name, null_percentage FROM ({_nulls_sql("registry", COLUMNS)})
        UNION ALL SELECT 'distinct', c, n FROM ("""
        + _union(
            f"SELECT '{c}' AS c, (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::DOUBLE AS n FROM registry"
            for c in TEXTS
        )
        + """) UNION ALL SELECT 'correlation', 'price_paid,year', round(corr(price_paid, year(date_added)), 6) FROM registry""",
        "registry",
    ),
)
def explore(spark, sf):
    rows = registry(spark, sf).withColumn("year", F.year("date_added"))
    found = profiling.explore(rows, ["price_paid"], [("price_paid", "year")], TEXTS)
    return found.filter("NOT (section = 'missing' AND item = 'year')")


@query(
    "dear_titles",
    with_views(
        "SELECT county, count(*) AS num_rows FROM registry WHERE price_paid > 400000 GROUP BY county", "registry"
    ),
)
def dear_titles(spark, sf):
    return reports.count_by(registry(spark, sf).filter(F.col("price_paid") > 400_000), "county")
