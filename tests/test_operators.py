"""Operators on small fixtures: edge cases, known results, properties."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deedscope.functions import scalars, sql_functions
from deedscope.operators import (
    cleaning, features, impute, joins, labelling, lorentz, models, profiling, reports, retrieval,
    sampling, series, text,
)
from deedscope.workload.tables import read

# --- cleaning ----------------------------------------------------------------------------------


def test_rogue_filter_drops_null(spark):
    df = spark.createDataFrame([("93347",), ("Freehold",), (None,)], "tenure string")
    assert [r[0] for r in cleaning.drop_rogue(df, "tenure", "93347").collect()] == ["Freehold"]


def test_lists_as_values_and_as_tables(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    keys = spark.createDataFrame([("a",), ("a",)], "k string")
    for listed in (["a"], keys):
        assert [r[0] for r in cleaning.without_listed(df, "k", listed).collect()] == ["b"]
        assert [r[0] for r in cleaning.only_listed(df, "k", listed).collect()] == ["a"]


def test_clean_strings(spark):
    df = spark.createDataFrame([(" St. [Helier], (JE)!? ", None, 1), ("", "A:B;", 2)], "a string, b string, n int")
    assert [tuple(r) for r in cleaning.clean_strings(df).collect()] == [("st helier je", "unknown", 1), ("", "ab", 2)]


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b,.()/-", "c&%#@", "d!?:;"])
    assert cleaning.clean_names(df).columns == ["a_b__", "candpercentnumberat", "d"]
    with pytest.raises(ValueError, match="collide"):
        cleaning.clean_names(spark.createDataFrame([(1, 2)], ["a b", "a_b"]))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("St Helier", "St Helier"),
        ("ST.HELIER, Esplandade", "St Helier Esplanade"),
        ("sthelier esplanande", "St Helier Esplanade"),
        ("St. Helier", "st helier"),  # dot and blank together do not match the rule
    ],
)
def test_standard_address(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert df.select(cleaning.standard_address("a")).first()[0] == want


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a int, b double, c string")
    assert cleaning.drop_empty_columns(df).dtypes == [("a", "int"), ("c", "string")]
    assert cleaning.non_null_columns(df.filter("c = 'y'")) == ["c"]


def test_not_finite_and_means(spark):
    rows = [(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)]
    df = spark.createDataFrame(rows, "x double")
    assert [r[0] for r in cleaning.drop_not_finite(df, ["x"]).collect()] == [1.0, 3.0]
    assert [r[0] for r in cleaning.fill_means(df, ["x"]).collect()] == [1.0, 2.0, 2.0, 2.0, 3.0]
    stats = profiling.nan_statistics(df.filter("x is null or x != double('inf')"), ["x"]).first()
    assert (stats["nan_cells"], stats["mean"], stats["stddev"]) == (1, 2.0, 1.0)


def test_conform(spark):
    df = spark.createDataFrame([("7", "x", "2024-01-02")], "a string, b string, c string")
    out = cleaning.conform(df, "c date, a int")
    assert out.dtypes == [("c", "date"), ("a", "int")]
    assert out.first()["a"] == 7
    with pytest.raises(ValueError, match="missing"):
        cleaning.conform(df, "zz int")


def test_blank_share(spark):
    df = spark.range(20_000).withColumn("x", F.lit(1))
    blanked = cleaning.blank_share(df, "x", F.col("id"), 0.2)
    share = blanked.filter("x is null").count() / 20_000
    assert abs(share - 0.2) < 0.02
    assert blanked.collect() == cleaning.blank_share(df.repartition(7), "x", F.col("id"), 0.2).orderBy("id").collect()


# --- profiles and comparisons ---------------------------------------------------------------------


def test_profile_counts_empty_text_and_unknown_columns(spark):
    df = spark.createDataFrame([("", 1), (None, 2), ("a", 2), ("a", None)], "s string, n int")
    got = {r["column_name"]: r for r in profiling.profile_columns(df, ["s", "n", "zz"]).collect()}
    assert (got["s"]["null_count"], got["s"]["distinct_count"], got["s"]["distinct_percentage"]) == (2, 3, 25.0)
    assert (got["n"]["min_value"], got["n"]["max_value"], got["n"]["avg_value"]) == (1.0, 2.0, 1.67)
    assert got["zz"]["column_exists"] is False
    assert profiling.profile_columns(df.limit(0)).filter("null_percentage = 0").count() == 2


def test_profile_json(spark):
    import json

    docs = profiling.profile_json(spark.createDataFrame([(1,)], "n int")).collect()
    assert json.loads(docs[0]["profile"])["num_rows"] == 1


def test_missing_summary(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 3)], "a int, b int, c int")
    row = profiling.missing_summary(df).first()
    assert (row["num_columns"], row["columns_with_null"], row["names_with_null"]) == (3, 2, "b,c")
    assert row["null_columns_percentage"] == 33.33


def test_compare_tables_matches_null_values(spark):
    a = spark.createDataFrame([("x",), (None,)], "c string")
    b = spark.createDataFrame([(None,), (None,), ("y",), ("y",)], "c string")
    got = {r["value"]: (r["original_rows"], r["synthetic_rows"], r["share_difference"]) for r in profiling.compare_tables(a, b).collect()}
    assert got == {"x": (1, 0, -0.5), None: (1, 2, 0.0), "y": (0, 2, 0.5)}


# --- labels -------------------------------------------------------------------------------------


def test_labels_follow_three_valued_logic(spark):
    rows = [
        (None, "a", "b", "UK", "addr", "Freehold"),  # unknown price does not flag
        (2_000_000, "a", "b", "UK", "addr", "Freehold"),
        (1, None, "b", "UK", "addr", "Leasehold"),
        (1, "a", None, "UK", "addr", "Freehold"),
        (1, "a", "b", None, "addr", "Freehold"),  # unknown country does not flag
        (1, "a", "b", "JERSEY", "addr", None),
        (1, "a", "b", "UK", None, "Freehold"),
    ]
    df = spark.createDataFrame(
        rows, "price_paid int, proprietor1 string, proprietor2 string, country string, address1 string, tenure string"
    )
    assert [r["is_fraud"] for r in labelling.label_by_owner(df).collect()] == [0, 1, 1, 0, 0, 1, 0]
    assert [r["is_fraud"] for r in labelling.label_by_gaps(df).collect()] == [0, 1, 1, 1, 0, 1, 1]
    averages = spark.createDataFrame([(1.0,), (2e6,), (None,)], "average_price double")
    assert [r["is_fraud"] for r in labelling.label_by_average(averages).collect()] == [0, 1, 1]


def test_known_record_is_flagged(spark):
    # A published record with its labels.
    df = spark.createDataFrame(
        [(5275000, "VICKSBURG GLOBAL INC", None, "BRITISH VIRGIN ISLANDS", "12-14 Walton Street, London SW3 1RE")],
        "price_paid int, proprietor1 string, proprietor2 string, country string, address1 string",
    )
    row = labelling.label_by_gaps(df).first()
    assert (row["missing_proprietor_name"], row["is_fraud"]) == (1, 1)


# --- reports and joins ------------------------------------------------------------------------------


def test_top_ranked_keeps_all_ties(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "id int, n int")
    top = reports.top_ranked(df, "n", ranks=2)
    assert top.count() == 20
    assert {(r["n"], r["rank"]) for r in top.collect()} == {(4, 1), (3, 2)}


def test_price_comparison_equals_the_fan_out_join(spark):
    flagged = spark.createDataFrame(
        [("C", "York", 100.0), ("C", "York", 300.0), ("C", "YORK", 50.0), ("C", None, 9.0), ("C", "Hull", None)],
        "county string, district string, price_paid double",
    )
    index = spark.createDataFrame([("york", 10.0), ("york", 30.0), ("Hull", 5.0)], "region_name string, average_price double")
    flagged.createOrReplaceTempView("bd")
    index.createOrReplaceTempView("gd")
    want = spark.sql(
        """SELECT bd.county, bd.district, round(avg(bd.price_paid)) a, round(avg(gd.average_price)) b
        FROM gd LEFT JOIN bd ON lower(gd.region_name) = lower(bd.district)
        WHERE coalesce(bd.district, 'NULL') <> 'NULL' GROUP BY bd.county, gd.region_name, bd.district"""
    )
    got = reports.price_comparison(flagged, index).drop("price_ratio")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_distinct_pairs_equal_distinct_of_the_join(spark):
    left = spark.createDataFrame([("A", 1), ("A", 1), ("b", 2), (None, 3)], "region string, x int")
    right = spark.createDataFrame([("a", 5), ("a", 5), ("a", 6), (None, 7)], "district string, x int")
    got = joins.distinct_pairs(left, right, "region", "district")
    assert sorted(map(tuple, got.collect())) == [("a", "A", 1, "a", 5), ("a", "A", 1, "a", 6)]


def test_size_totals(spark):
    # Lines of a published size listing, and odd ones that are left out.
    lines = ["9.9M ./0.6.0", " 10M ./0.6.1", "117M ./2.0.0", "1.1G ./3.0.1", "nonsense", "5K ./1.0.0", "7M ./x"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["major_release"]: r["total_megabytes"] for r in reports.size_totals(df).collect()}
    assert got == {"0": 19.9, "2": 117.0, "3": 1126.4, "Total": 1263.3}


# --- sampling -----------------------------------------------------------------------------------------


def test_sampling(spark):
    df = spark.range(10_000)
    assert abs(sampling.bootstrap(df, 0.3).count() - 3_000) < 300
    bigger = sampling.augment(df, 0.3)
    assert bigger.distinct().count() == 10_000 and bigger.count() > 12_000
    assert sorted(r[0] for r in sampling.shuffle_rows(df).collect()) == list(range(10_000))
    train, test = sampling.hash_split(df, "id")
    assert train.count() + test.count() == 10_000 and abs(train.count() - 8_000) < 300
    assert train.join(test, "id").count() == 0
    assert sorted(train.collect()) == sorted(sampling.hash_split(df.repartition(3), "id")[0].collect())
    a, b = sampling.random_split(df)
    assert a.count() + b.count() == 10_000
    assert sampling.cap_rows(df, 7).count() == 7


# --- series ---------------------------------------------------------------------------------------------

# 36 published monthly prices from 2021-02, and the cubic forecasts for the
# twelve months after them.
AVERAGE_PRICES = [
    1265469.0, 1224768.0, 1198159.0, 1223380.0, 1196736.0, 1321844.0, 1445633.0, 1515740.0, 1527601.0,
    1447296.0, 1410458.0, 1371047.0, 1374360.0, 1441513.0, 1513572.0, 1518352.0, 1520758.0, 1503688.0,
    1517723.0, 1527039.0, 1410576.0, 1376685.0, 1304428.0, 1364872.0, 1350849.0, 1384497.0, 1334814.0,
    1363774.0, 1400045.0, 1376043.0, 1366026.0, 1315895.0, 1375884.0, 1268656.0, 1199227.0, 1197249.0,
]
CUBIC_FORECASTS = [
    1228172.64, 1215534.57, 1203800.15, 1193100.66, 1183567.42, 1175331.72, 1168524.88, 1163278.17,
    1159722.92, 1157990.41, 1158211.95, 1160518.85,
]


@pytest.fixture(scope="module")
def monthly(spark):
    rows = [
        ("average", datetime.date(2021 + (i + 1) // 12, (i + 1) % 12 + 1, 1), p) for i, p in enumerate(AVERAGE_PRICES)
    ]
    return spark.createDataFrame(rows, "s string, date_taken date, price double")


def test_cubic_forecast(monthly):
    got = series.polynomial_trend(monthly, ["s"]).orderBy("date_taken").collect()
    assert got[0]["date_taken"] == datetime.date(2024, 2, 1)
    assert [round(r["forecast"], 2) for r in got] == CUBIC_FORECASTS


def test_repeated_rows_do_not_change_a_fit(monthly):
    once = series.polynomial_trend(monthly, ["s"]).orderBy("date_taken").collect()
    thrice = series.polynomial_trend(monthly.unionAll(monthly).unionAll(monthly), ["s"]).orderBy("date_taken").collect()
    assert [r["forecast"] for r in thrice] == pytest.approx([r["forecast"] for r in once])


def test_short_series_has_no_cubic(monthly):
    got = series.polynomial_trend(monthly.limit(3), ["s"]).collect()
    assert len(got) == 12 and all(r["forecast"] is None for r in got)


def test_linear_forecast_on_yyyymm(monthly):
    first = datetime.date(2024, 1, 1)
    got = series.linear_trend(monthly, ["s"], axis="year_month", first=first).orderBy("date_taken").collect()
    assert [round(r["forecast"], 2) for r in got[:2]] == [1347085.60, 1346942.42]


def test_seasonal_forecast_skips_missing_months(spark):
    start = [(2020 + m // 12, m % 12 + 1) for m in range(36)]
    rows = [("s", datetime.date(y, m, 1), 100.0 * m + 10 * (y - 2020)) for y, m in start if (y, m) != (2021, 5)]
    df = spark.createDataFrame(rows, "s string, date_taken date, price double")
    got = {r["date_taken"]: r for r in series.seasonal_forecast(df, ["s"]).collect()}
    assert len(got) == 12
    assert got[datetime.date(2023, 5, 1)]["forecast"] == 530.0
    assert got[datetime.date(2023, 5, 1)]["lower"] == pytest.approx(530.0)


@pytest.mark.parametrize("horizon", [6, 12, 24])
def test_forecasts_are_whole(spark, horizon):
    """A row for each key and month of the horizon, whatever months are missing."""
    months = [(k, m) for k in ("a", "b", "c") for m in range(48 if k == "a" else 3) if (k, m % 12) != ("a", 7)]
    rows = [(k, datetime.date(2018 + m // 12, m % 12 + 1, 1), 100.0 + m) for k, m in months]
    rows.append(("d", datetime.date(2020, 1, 1), 5.0))
    df = spark.createDataFrame(rows, "s string, date_taken date, price double")
    for found in (
        series.seasonal_forecast(df, ["s"], horizon=horizon), series.combined_forecast(df, ["s"], horizon=horizon),
    ):
        got = found.collect()
        assert len({(r["s"], r["date_taken"]) for r in got}) == len(got) == 4 * horizon
    by = {(r["s"], r["date_taken"]): r["forecast"] for r in series.seasonal_forecast(df, ["s"], horizon=horizon).collect()}
    assert by["a", datetime.date(2022, 3, 1)] == pytest.approx(150.0)  # a year earlier plus a year's change
    assert by["b", datetime.date(2018, 4, 1)] == pytest.approx(103.0)  # no such month yet: the line
    assert by["d", datetime.date(2020, 2, 1)] == 5.0
    if horizon >= 8:
        assert by["a", datetime.date(2022, 8, 1)] == pytest.approx(155.0)  # never seen: the line
    combined = series.combined_forecast(df, ["s"], horizon=horizon).filter("s = 'd'").collect()
    assert all(r["linear"] is None and r["combined"] is not None for r in combined)


def test_weighted_line_is_that_of_the_rows(spark):
    rng = np.random.default_rng(1)
    rows = [("k", datetime.date(2015 + m // 12, m % 12 + 1, 1 + i), float(rng.normal(m))) for m in range(40) for i in range(1 + m % 3)]
    df = spark.createDataFrame(rows, "s string, date_taken date, price double")
    x = np.array([d.year * 12 + d.month - 1 for _, d, _ in rows], float)
    slope, base = np.polyfit(x - 24000, [p for *_, p in rows], 1)
    got = series.linear_trend(df, ["s"], horizon=3).orderBy("date_taken").collect()
    for r in got:
        t = r["date_taken"].year * 12 + r["date_taken"].month - 1 - 24000
        assert r["forecast"] == pytest.approx(slope * t + base)


def test_gaps_per_key(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [("a", day(1), 1.0), ("a", day(1), 2.0), ("a", day(4), 3.0), ("b", day(9), 4.0), (None, day(1), 5.0), (None, day(3), 6.0), ("a", None, 7.0)]
    df = spark.createDataFrame(rows, "k string, day date, v double")
    gaps = {(r["k"], r["day"].day) for r in series.calendar_gaps_per_key(df, ["k"], "day").collect()}
    assert gaps == {("a", 2), ("a", 3), (None, 2)}
    filled = series.fill_gaps_per_key(df, ["k"], "day", "v").collect()
    assert len(filled) == len(rows) + 3 and all(67.5 <= r["v"] <= 72.3 for r in filled if r["filled"])


def test_bootstrap_is_the_same_on_any_partitions(spark):
    from collections import Counter

    from deedscope.operators import sampling

    df = spark.range(5_000).select("id", (F.col("id") % 7).alias("x"))
    runs = [Counter(r["id"] for r in sampling.bootstrap(df.repartition(n), 0.8, key=["id"]).collect()) for n in (3, 5)]
    assert runs[0] == runs[1]
    assert abs(sum(runs[0].values()) - 4_000) < 5 * 4_000**0.5 and max(runs[0].values()) > 2
    assert sampling.bootstrap(df, 0.8, seed=1).count() != sampling.bootstrap(df, 0.8, seed=2).count()


def test_negative_zero_is_zero(spark):
    from deedscope.operators import profiling

    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,)], "x double")
    assert profiling.null_and_distinct(df).first()["distinct_count"] == 3


def test_profile_of_every_number_type(spark):
    from deedscope.operators import profiling

    df = spark.sql(
        "SELECT CAST(id AS BIGINT) AS b, CAST(id AS SMALLINT) AS s, CAST(id AS DECIMAL(10, 2)) AS d, CAST(id AS FLOAT) AS f, "
        "CAST(NULL AS INT) AS n, CAST(id AS STRING) AS t, 7 AS one FROM range(10)"
    )
    by = {r["column_name"]: r for r in profiling.profile_columns(df, bins=3).collect()}
    for c in "bsdf":
        assert (by[c]["min_value"], by[c]["max_value"], by[c]["avg_value"]) == (0, 9, 4.5)
        assert [h["num_rows"] for h in by[c]["histogram"]] == [3, 3, 4]
        assert [h["left_edge"] for h in by[c]["histogram"]] == [0, 3, 6] and by[c]["histogram"][2]["right_edge"] == 9
    assert by["n"]["histogram"] is None and by["t"]["histogram"] is None and by["n"]["min_value"] is None
    assert sum(h["num_rows"] for h in by["one"]["histogram"]) == 10


def test_boosted_and_combined_forecasts(spark):
    rows = [
        (s, datetime.date(2018 + m // 12, m % 12 + 1, 1), base + 2.0 * m)
        for s, base in (("a", 100.0), ("b", 1_000.0)) for m in range(48)
    ]
    df = spark.createDataFrame(rows, "s string, date_taken date, price double")
    got = series.combined_forecast(df, ["s"], horizon=3).collect()
    assert len(got) == 6
    for r in got:
        assert abs(r["linear"] - r["seasonal"]) < 1
        assert abs(r["boosted"] - r["linear"]) / r["linear"] < 0.15
        assert r["combined"] == pytest.approx((r["linear"] + r["boosted"] + r["seasonal"]) / 3)


def test_boosted_trend_fits_all_trees_on_all_months(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    fitted, plain = [], GBTRegressor.fit

    def fit(self, training):
        fitted.append((self, training.count(), plain(self, training)))
        return fitted[-1][2]

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    # The first tree fits best by far: a check for little improvement would stop at once.
    rows = [
        (s, datetime.date(2018 + m // 12, m % 12 + 1, 1), base * (1 + (m >= 24)) + m % 3)
        for s, base in (("a", 100.0), ("b", 1_000.0)) for m in range(48)
    ]
    df = spark.createDataFrame(rows, "s string, date_taken date, price double")
    assert series.boosted_trend(df, ["s"], horizon=2, trees=30).count() == 4
    [(boosting, n, model)] = fitted
    assert n == 96 and not boosting.isSet("validationIndicatorCol") and model.getNumTrees == 30


def test_gaps(spark):
    days = [datetime.date(2023, 10, 24), datetime.date(2023, 10, 26), datetime.date(2023, 10, 26)]
    df = spark.createDataFrame([(d, 70.0) for d in days], "day date, weight double")
    start, end = datetime.date(2023, 10, 23), datetime.date(2023, 10, 27)
    gaps = [r["day"].day for r in series.calendar_gaps(df, "day", start, end).orderBy("day").collect()]
    assert gaps == [23, 25, 27]
    filled = series.fill_gaps(df, "day", "weight", start, end)
    assert filled.count() == 6
    assert all(67.5 <= r["weight"] <= 72.3 and round(r["weight"], 1) == r["weight"] for r in filled.collect())
    assert series.calendar_gaps(df, "day", days[1], days[1]).count() == 0


@pytest.mark.parametrize("max_points", [200_000, 79])
def test_lorentzian_parameters_are_recovered(spark, max_points):
    truth = {0: (3.0, 10.0, 2.0), 1: (5.5, 14.0, 1.2), 2: (1.0, 6.0, 3.5)}
    rows = [
        (k, x / 4, h * w * w / ((x / 4 - c) ** 2 + w * w))
        for k, (h, c, w) in truth.items() for x in range(80) for _ in range(3 if k == 1 else 1)
    ]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    fits = lorentz.fit_lorentzian(df, ["k"], "x", "y", max_points=max_points)
    for r in fits.collect():
        assert (r["height"], r["centre"], r["half_width"]) == pytest.approx(truth[r["k"]], rel=1e-6)
        assert r["amplitude"] == pytest.approx(math.pi * r["height"] * r["half_width"])
        assert r["squared_error"] < 1e-9 < r["start_error"] and not r["at_bound"]
    curve = lorentz.fitted_values(df, fits, ["k"], "x")
    assert curve.agg(F.max(F.abs(F.col("y") - F.col("best_fit")))).first()[0] < 1e-6


def test_lorentzian_of_odd_series(spark):
    """One point, one x, flat points, a peak beyond the points, missing cells, a NULL key."""
    peak = [(float(x), 5e6 / ((x - 400) ** 2 + 100)) for x in range(50)]
    rows = [("one", 3.0, 2.0), ("same", 1.0, 2.0), ("same", 1.0, 4.0), ("gap", None, 1.0), ("gap", 1.0, None)]
    rows += [("flat", float(x), 7.0) for x in range(20)] + [("far", *p) for p in peak]
    rows += [(None, x / 4, 12 / ((x / 4 - 9) ** 2 + 4)) for x in range(80)]
    fits = {r["k"]: r for r in lorentz.fit_lorentzian(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert fits.keys() == {"one", "same", "flat", "far", None}
    assert (fits["one"]["height"], fits["one"]["centre"]) == (2.0, 3.0) and fits["same"]["height"] == 3.0
    assert fits["same"]["squared_error"] == pytest.approx(0)
    assert (fits[None]["height"], fits[None]["centre"], fits[None]["half_width"]) == pytest.approx((3, 9, 2), rel=1e-6)
    assert fits["far"]["at_bound"] and fits["far"]["centre"] == pytest.approx(24.5 + 49)
    assert fits["flat"]["at_bound"] and fits["flat"]["height"] == pytest.approx(7, rel=1e-2)


def test_lorentzian_of_points_that_dip_comes_near_their_mean(spark):
    """Without a peak the widest curve is best; one held at ten ranges errs by more than the mean does."""
    rows = [(k, float(x), 250_000 + size * (x - 39.5) ** 2) for k, size in enumerate((1.0, 0.01, -30.0)) for x in range(80)]
    fits = {r["k"]: r for r in lorentz.fit_lorentzian(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").collect()}
    for k in (0, 1):
        y = [v for i, _, v in rows if i == k]
        around = sum((v - sum(y) / 80) ** 2 for v in y)
        assert fits[k]["squared_error"] <= 1.00001 * around and fits[k]["at_bound"]
    assert fits[2]["centre"] == pytest.approx(39.5) and not fits[2]["at_bound"]


def test_known_quantiles_serve_drawing_and_ranks(spark):
    from deedscope.operators.gram import complete_rows, quantile_grid, rank_correlations

    rng = np.random.default_rng(3)
    rows = [(float(a), float(a + b), None if i % 50 == 0 else float(i % 7)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, c double").coalesce(1)
    complete = complete_rows(df, ["a", "b", "c"])
    grid = quantile_grid(complete, complete.columns, 1000)
    assert grid[0].shape == (3, 1001)
    drawn = [impute.draw_rows(df, ["a", "b", "c"], 200, **o).orderBy("id").collect() for o in ({}, {"grid": grid})]
    assert drawn[0] == drawn[1]
    assert rank_correlations(df, ["a", "b", "c"], grid=grid) == pytest.approx(rank_correlations(df, ["a", "b", "c"]))


# --- features and models ------------------------------------------------------------------------------------


def test_string_index(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 4), ("c", 5)], "k string, v int")
    skip = {r["v"]: r["k_index"] for r in features.string_index(df, "k").collect()}
    keep = {r["v"]: r["k_index"] for r in features.string_index(df, "k", invalid="keep").collect()}
    assert skip == {1: 1.0, 2: 0.0, 4: 0.0, 5: 2.0}
    assert keep == skip | {3: 3.0}


def test_string_index_equals_spark_ml(spark, sf):
    from pyspark.ml.feature import StringIndexer

    df = read(spark, sf, "part").select("p_partkey", "p_name")
    want = StringIndexer(inputCol="p_name", outputCol="i").fit(df).transform(df)
    got = features.string_index(df, "p_name", output="i")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_encode_table(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y z"), (None, None)], "w string, n string")
    got = features.encode_table(df, label_above=2)
    assert got.columns == ["w_a", "w_b", "n_x", "n_y_z"]
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 0)]
    many = spark.range(90).select(*[F.concat(F.lit(f"{c}-"), "id").alias(f"c{c}") for c in range(12)])
    assert len(features.encode_table(many).columns) == 12 * 90  # wide as a table, narrow in each column
    with pytest.raises(features.TooManyRows):
        features.dummies(many, ["c0"], max_width=89)
    labelled = features.encode_table(df, ["w"], label_above=1)
    assert {r["n"]: r["w"] for r in labelled.collect()} == {None: 0, "x": 1, "y z": 2}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    scaling = features.Scaling(df, ["a", "b"])
    scaled = scaling.apply(df)
    a = np.array([1.0, 2.0, 6.0])
    assert [r["a"] for r in scaled.collect()] == pytest.approx(list((a - a.mean()) / a.std()))
    assert [r["b"] for r in scaled.collect()] == [0.0, 0.0, 0.0]
    assert [r["a"] for r in scaling.invert(scaled).collect()] == pytest.approx([1.0, 2.0, 6.0])


def test_area_under_roc(spark):
    rows = [(int(i % 3 == 0), float((i * 7) % 11)) for i in range(120)] + [(None, 1.0), (1, None)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(5)
    known = [(a, s) for a, s in rows if a is not None and s is not None]
    pos, neg = [s for a, s in known if a == 1], [s for a, s in known if a == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    row = models.area_under_roc(df, "label", "score").first()
    assert (row["positives"], row["negatives"]) == (len(pos), len(neg))
    assert row["auc"] == pytest.approx(want)


def test_forest_learns_a_rule(spark):
    df = spark.range(2_000).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("c"),
    ).withColumn("label", (F.col("x") > 60).cast("int"))
    model, scores = models.train_forest(df, label="label", categorical=["c"], numeric=["x"], trees=5)
    row = scores.first()
    assert row["train_auc"] > 0.97 and row["test_auc"] > 0.97
    own = models.area_under_roc(models.scored_table(models.fit_forest(df, label="label", categorical=["c"], numeric=["x"], trees=5), df, [], "label"), "label", "probability")
    assert own.first()["auc"] > 0.97
    scored = models.scored_table(model, df, ["id"], "label")
    assert scored.columns == ["id", "label", "prediction", "probability"]
    assert scored.filter("prediction != label").count() < 40


def test_reconstruction_improves_with_components(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(600, 2))
    x = z @ rng.normal(size=(2, 4)) * 3 + 10 + rng.normal(size=(600, 4)) * 0.05
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    gaps = cleaning.blank_share(df, "a", F.col("id"), 0.02)
    columns = ["a", "b", "c", "d"]
    errors = []
    for k in (1, 2):
        done = impute.reconstruct_missing(gaps, columns, k=k, initial="mean")
        assert done.columns == df.columns and done.filter("a is null").count() == 0
        both = done.alias("p").join(df.alias("q"), "id").join(gaps.select("id", F.col("a").alias("g")), "id")
        assert both.filter("g is not null and p.a != q.a").count() == 0
        errors.append(both.filter("g is null").agg(F.avg(F.pow(F.col("p.a") - F.col("q.a"), F.lit(2)))).first()[0])
    spread = df.agg(F.var_pop("a")).first()[0]
    assert errors[1] < errors[0] < spread
    zero = impute.reconstruct_missing(gaps, columns, k=1)
    assert zero.columns == df.columns and zero.filter("a is null").count() == 0
    limited = impute.reconstruct_missing(gaps, columns, k=2, bounds={"a": (0.0, 1.0)})
    assert limited.join(gaps.filter("a is null").select("id"), "id").filter("a > 1 or a < 0").count() == 0


def test_rounds_fill_better_than_one_pass(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(800, 2))
    x = z @ rng.normal(size=(2, 5)) * 3 + 40 + rng.normal(size=(800, 5)) * 0.1
    gone = rng.random(x.shape) < 0.2
    columns = list("abcde")
    cells = [[None if g else float(v) for v, g in zip(r, h)] for r, h in zip(x, gone)]
    schema = "id int, " + ", ".join(f"{c} double" for c in columns)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(cells)], schema).repartition(3)
    error = {}
    for name, done in {
        "zero": impute.reconstruct_missing(df, columns), "mean": impute.reconstruct_missing(df, columns, initial="mean"),
        "rounds": impute.reconstruct_iterated(df, columns),
    }.items():
        got = np.array([r[1:] for r in done.orderBy("id").collect()], float)
        assert (got[~gone] == x[~gone]).all()
        error[name] = ((got - x)[gone] ** 2).mean()
    assert error["rounds"] < error["mean"] / 5 and error["rounds"] < error["zero"] / 5
    odd = spark.createDataFrame([(None, None, 1.0), (None, 2.0, 1.0), (None, None, 1.0), (None, 4.0, None)], "a double, b double, c double")
    assert sorted(map(tuple, impute.reconstruct_iterated(odd, ["a", "b", "c"], bounds={"a": (5, 6)}).collect())) == [
        (5.0, 2.0, 1.0), (5.0, pytest.approx(3.0), 1.0), (5.0, pytest.approx(3.0), 1.0), (5.0, 4.0, pytest.approx(1.0)),
    ]
    assert impute.reconstruct_iterated(odd.limit(0), ["a", "b"]).collect() == []


def test_correlations_of_a_wide_table_with_gaps(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 80)) + rng.normal(size=(300, 1)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3], x[1:, 4] = 5.0, np.nan
    columns = [f"c.{i}" for i in range(80)]
    cells = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame(cells, ", ".join(f"`{c}` double" for c in columns)).repartition(4)
    found = {(r.column_a, r.column_b): r.correlation for r in profiling.correlations(df, columns).collect()}
    want = pd.DataFrame(x, columns=columns).corr(min_periods=2)
    assert len(found) == 6_400
    for (a, b), r in found.items():
        if "c.4" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9, nan_ok=True), (a, b)


def test_smoothing_of_odd_series(spark):
    month = lambda i: datetime.date(2000 + i // 12, i % 12 + 1, 15)
    rows = [("season", month(i), 100.0 + 2 * i + 10 * (i % 12 == 5)) for i in range(60)]
    rows += [("gap", month(i), 50.0 + (i % 12)) for i in range(60) if i not in (7, 20, 33, 34)]
    rows += [("twice", month(i), v) for i in range(30) for v in (1.0, 3.0)]
    rows += [("one", month(3), 7.0), ("short", month(1), 4.0), ("short", month(4), 6.0), (None, month(2), 9.0), ("none", month(2), None)]
    df = spark.createDataFrame(rows, "k string, date_taken date, price double").repartition(3)
    found = {}
    for r in series.smoothed_forecast(df, ["k"]).orderBy("k", "date_taken").collect():
        found.setdefault(r["k"], []).append(r)
    assert found.keys() == {"season", "gap", "twice", "one", "short", None} and {len(v) for v in found.values()} == {12}
    assert [r["forecast"] for r in found["season"]] == pytest.approx([100 + 2 * i + 10 * (i % 12 == 5) for i in range(60, 72)], abs=2)
    assert [r["forecast"] for r in found["gap"]] == pytest.approx([50 + i % 12 for i in range(60, 72)], abs=2)
    assert [r["forecast"] for r in found["twice"]] == pytest.approx([2.0] * 12)
    assert found["one"][0]["lower"] is None and {r["forecast"] for r in found[None]} == {9.0}
    assert found["short"][0]["forecast"] == 5.0 and found["short"][0]["date_taken"] == datetime.date(2000, 6, 1)
    assert {r["alpha"] for r in series.smoothed_models(df, ["k"]).collect()} <= set(series.LEVEL_WEIGHTS)


def test_impute_table_fills_text_too(spark):
    rows = [(i, float(i % 2) * 10 + i % 3, "hi" if i % 2 else "lo", f"name{i % 2}{i % 7}") for i in range(200)]
    rows += [(900, 11.0, None, "name10"), (901, None, "lo", "name00"), (902, 0.0, "lo", None)]
    df = spark.createDataFrame(rows, "id int, x double, level string, name string")
    done = impute.impute_table(df, numeric=["x"], text=["level", "name"], label_above=5)
    got = {r["id"]: r for r in done.collect()}
    assert done.columns == df.columns and len(got) == 203
    assert all(tuple(got[r[0]]) == r for r in rows[:200])
    assert got[900]["level"] == "hi" and got[901]["x"] < 6
    assert got[902]["name"] in {r[3] for r in rows}


def test_drawn_rows_keep_the_moments(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 1)) * [4.0, -2.0, 1.0] + [10.0, 20.0, 30.0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    drawn = impute.draw_rows(df, ["a", "b", "c"], 4_000, k=1)
    low, high = df.agg(F.min("a"), F.max("a")).first()
    assert drawn.filter((F.col("a") < low) | (F.col("a") > high)).count() == 0
    few = df.select(F.round(F.col("a") / 10).alias("a"), "b")
    values = {r["a"] for r in few.collect()}
    assert {r["a"] for r in impute.draw_rows(few, ["a", "b"], 500).collect()} <= values
    with pytest.raises(ValueError):
        impute.draw_rows(df.limit(0), ["a"], 3)
    stats = drawn.agg(F.avg("a"), F.stddev("a"), F.corr("a", "b")).first()
    assert stats[0] == pytest.approx(x[:, 0].mean(), abs=0.4)
    assert stats[1] == pytest.approx(x[:, 0].std(), rel=0.1)
    assert stats[2] == pytest.approx(-1.0, abs=0.01)


def test_kept_sketches_merge_to_those_of_all_rows(spark):
    rows = spark.range(20_000).selectExpr("id % 7 AS day", "IF(id % 10 = 0, NULL, id % 3000) AS user", "double(id) AS x")
    merged = profiling.read_sketches(profiling.merge_sketches(profiling.sketch_columns(rows, ["day"], distinct=["user"], numbers=["x"])), [0.1, 0.5])
    row = merged.first()
    assert (row["num_rows"], row["user_nulls"], row["x_nulls"]) == (20_000, 2_000, 0)
    assert row["user_distinct"] == pytest.approx(2_700, rel=0.05)
    assert row["x_quantiles"] == pytest.approx([2_000, 10_000], abs=20_000 * 0.05)


def test_poisson_counts_follow_the_distribution(spark):
    units = spark.range(4_000).select((F.col("id") / 4_000).alias("u"))
    for mean in (0.2, 3.0):
        counts = [r[0] for r in units.select(sampling.poisson_count(F.col("u"), mean)).collect()]
        share = [math.exp(-mean) * mean**k / math.factorial(k) for k in range(6)]
        assert [counts.count(k) / 4_000 for k in range(6)] == pytest.approx(share, abs=0.001)
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(3_000)], "k int, v string")
    drawn = sampling.bootstrap(df, 0.5, key=["k"])
    assert drawn.count() == pytest.approx(1_500, rel=0.1) and drawn.columns == ["k", "v"]
    assert sorted(map(str, drawn.collect())) == sorted(map(str, sampling.bootstrap(df.repartition(7), 0.5, key=["k"]).collect()))


def plain_polarity(value, reach):
    if value is None:
        return None
    import regex

    words = [w for w in regex.split(r"[^\p{L}]+", value.lower()) if w]
    found = []
    for i, word in enumerate(words):
        if word in text.LEXICON:
            factor = math.prod(text.MODIFIERS.get(w, 1.0) for w in words[max(0, i - reach) : i])
            found.append(max(-1.0, min(1.0, text.LEXICON[word] * factor)))
    return sum(found) / len(found) if found else 0.0


@pytest.mark.parametrize("reach", [1, 2, 4])
def test_modified_polarity(spark, reach):
    rng = np.random.default_rng(7)
    words = [*text.LEXICON, *text.MODIFIERS, "the", "Überall", "x"]
    values = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(60)]
    values += [None, "", "!?", "NOT good", "not very good", "good not", "never, ever: great!", "very " * 50 + "best"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    found = {r[0]: r[1] for r in df.select("i", text.polarity_modified("t", reach=reach)).collect()}
    for i, value in enumerate(values):
        want = plain_polarity(value, reach)
        assert found[i] == (want if want is None else pytest.approx(want)), value
    assert text.LEXICON["good"] * -0.5 == pytest.approx(found[63])


@pytest.mark.parametrize("bound", [200_000, 0])
def test_polarity_join_with_and_without_broadcast(spark, bound):
    df = spark.createDataFrame([(1, "good bad good"), (2, "x"), (3, None), (None, "great")], "k int, t string")
    lexicon = spark.createDataFrame(list(text.LEXICON.items()), "word string, weight double")
    found = {r[0]: r[1] for r in text.polarity_join(df, lexicon, keys=["k"], text="t", max_broadcast_rows=bound).collect()}
    assert found == {1: pytest.approx(0.7 / 3), 2: 0.0, 3: None, None: 0.8}


def test_polarity_join_broadcasts_frequent_words_and_no_text_is_shuffled(spark):
    rows = [(1, "good bad good x"), (2, "x"), (3, None), (None, "great bad"), (4, "Good"), (4, "awful good")]
    df = spark.createDataFrame(rows, "k int, t string")
    seen = text.texts_with_word(df, keys=["k"], text="t")
    assert {r["word"]: r["texts"] for r in seen.collect()} == {"good": 2, "bad": 2, "x": 2, "great": 1, "awful": 1}
    lexicon = spark.createDataFrame([(w, x, i) for i, (w, x) in enumerate(text.LEXICON.items())], "word string, weight double, n int")
    options = {"keys": ["k"], "text": "t"}
    whole = sorted(text.polarity_join(df, lexicon, **options).collect(), key=str)
    parted = text.polarity_join(df, lexicon, max_broadcast_rows=12, frequency="n", **options)
    got = sorted(parted.collect(), key=str)
    assert [r["k"] for r in got] == [r["k"] for r in whole]
    assert [r["polarity"] for r in got] == [x if x is None else pytest.approx(x) for x in (r["polarity"] for r in whole)]
    shuffled = [line for line in parted._jdf.queryExecution().toString().splitlines() if "Exchange hashpartitioning(t" in line]
    joined = [n for n in parted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in n and "isnotnull(t" in n]
    assert not shuffled and joined


# --- retrieval and text ----------------------------------------------------------------------------------------


def brute_force(vectors, queries, k):
    found = {}
    for qid, q in queries:
        ranked = sorted((float(((np.array(v) - np.array(q)) ** 2).sum()), i) for i, v in vectors)[:k]
        found[qid] = [i for _, i in ranked]
    return found


def test_nearest_holds_few_distances_at_a_time():
    """Blocks of rows give the rows of all distances at once, with many copies too, in little memory."""
    import tracemalloc

    from deedscope.operators.retrieval import _closest

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6_000, 8))
    vectors[1_000:4_000] = vectors[7]
    queries = np.concatenate([vectors[:40], rng.normal(size=(540, 8)), vectors[990:1_010]])
    ids = rng.permutation(6_000)
    tracemalloc.start()
    got = _closest(ids, vectors, queries, 3).sort_values(["q", "distance", "id"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [ids[np.lexsort((ids, ((vectors - q) ** 2).sum(axis=1)))[:3]].tolist() for q in queries]
    assert got.groupby("q")["id"].apply(list).tolist() == want
    # All distances of a query chunk took several copies of 4,000,000 numbers before.
    assert most < 40e6


@pytest.mark.parametrize("batch_bytes", [1 << 20, 8 * 4 * 20])
def test_nearest_equals_brute_force(spark, batch_bytes):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(150)]
    # A third of all vectors are copies of one.
    vectors += [(150 + i, vectors[0][1]) for i in range(75)]
    queries = [(f"q{i}", [float(x) for x in rng.normal(size=4)]) for i in range(50)] + [("copy", vectors[0][1])]
    docs = spark.createDataFrame(vectors, "id int, v array<double>").repartition(4)
    asked = spark.createDataFrame(queries, "qid string, v array<double>").repartition(3)
    found = retrieval.nearest(
        docs, asked, doc_id="id", doc_vector="v", query_id="qid", query_vector="v", k=3, batch_bytes=batch_bytes
    )
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == brute_force(vectors, queries, 3)


def test_nearest_with_few_documents(spark):
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "id int, v array<double>")
    asked = spark.createDataFrame([(9, [0.0, 0.0])], "qid int, v array<double>")
    rows = retrieval.nearest(docs, asked, doc_id="id", doc_vector="v", query_id="qid", query_vector="v").collect()
    assert [(r["doc_id"], r["distance"], r["rank"]) for r in rows] == [(1, 0.0, 1), (2, 25.0, 2)]


@pytest.mark.parametrize("max_broadcast_rows", [100, 0])
def test_context(spark, max_broadcast_rows):
    found = spark.createDataFrame([(1, 10, 0.1, 2), (1, 11, 0.0, 1)], "query_id int, doc_id int, distance double, rank int")
    docs = spark.createDataFrame([(10, "beta"), (11, "alpha")], "d int, t string")
    asked = spark.createDataFrame([(1, "why?")], "q int, t string")
    row = retrieval.retrieve_context(
        found, docs, asked, doc_id="d", doc_text="t", query_id="q", query_text="t",
        max_broadcast_rows=max_broadcast_rows,
    ).first()
    assert row["context"] == "alpha beta why?"


def test_chunks(spark):
    sentence = "This is a very long document that needs to be split into smaller chunks for processing. "
    rows = [(1, sentence * 50), (2, "  one\n\ttwo "), (3, "   "), (4, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    chunks = text.split_documents(df, key="id", text="t").orderBy("id", "chunk_no").collect()
    long = [r["chunk"] for r in chunks if r["id"] == 1]
    words = (sentence * 50).split()
    assert long == [" ".join(words[i : i + 512]) for i in range(0, len(words), 512)]
    assert [(r["id"], r["chunk"]) for r in chunks if r["id"] > 1] == [(2, "one two")]


def test_polarity(spark):
    rows = [("Great product, durable and reliable.",), ("AWFUL!",), ("no such word",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(text.polarity("t")).collect()]
    assert got == [pytest.approx(0.5), -1.0, 0.0, None]


# --- functions ---------------------------------------------------------------------------------------------------


def test_sql_functions(spark):
    assert "pad_single" in sql_functions.register_sql_functions(spark)
    row = spark.sql(
        """SELECT timestamp_text(TIMESTAMP '2024-01-02 03:04:05') a, substring_between('abcdef', 2, 4) b, clustered(7.9, 2) c,
        clustered_exact(8, 2) d, scattered(0, 5) e, pad_sequence('x', 3) f, pad_single('ab', 2) g, to_int('3.9') h,
        to_int('no') i, element_or_null(array(1.5D), 0) j, element_or_null(array(1.5D), 4) k, randomised(5, 10, 1) l"""
    ).first()
    assert tuple(row)[:11] == ("2024-01-02 03:04:05", "bcd", 3.0, 3.5, 4.0, "123x", "abab", 3, None, 1.5, None)
    assert 0 <= row["l"] < 10


def test_random_functions(spark):
    df = spark.range(50)
    rows = df.select(
        sql_functions.random_text(6, 1).alias("t"), sql_functions.pad_random("id", 8, 2).alias("p"),
        sql_functions.randomised("id", 7, 3).alias("r"), sql_functions.randomised_normal(5, 4).alias("n"), "id",
    ).collect()
    assert all(len(r["t"]) == 6 and len(r["p"]) == 8 and r["p"].endswith(str(r["id"])) for r in rows)
    assert all(0 <= r["r"] < 7 and r["n"] >= 0 for r in rows)


def test_scalar_edges(spark):
    df = spark.createDataFrame([(None, 9_000_000_000, [1.0])], "x double, big bigint, v array<double>")
    row = df.select(
        scalars.clip("x", 0.0, 1.0).alias("clip"), scalars.square("big").alias("sq"),
        scalars.element_or_null("v", 3).alias("e"), sql_functions.stddev_of_array("v").alias("s"),
    ).first()
    assert row["clip"] is None and row["e"] is None and row["s"] == 0.0
    assert int(row["sq"]) == 81_000_000_000_000_000_000
