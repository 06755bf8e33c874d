"""Physical plan pieces: order, skew, size checks, and what plans must not hold."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from deedscope.operators import joins, profiling
from deedscope.operators.quantiles import exact_quantiles
from deedscope.plans import lineage
from deedscope.plans.ordinal import with_row_number, with_running_totals
from deedscope.plans.sizing import TooManyRows, bounded_rows, has_at_most
from deedscope.plans.skew import hot_keys, join_split_hot
from deedscope.sources import catalog
from deedscope.workload import QUERIES
from deedscope.workload.tables import SCHEMAS, read


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, rows=3_000):
    """A third of the rows share key 7."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100)
    return spark.range(0, rows, 1, 6).select(key.alias("k"), F.col("id").alias("v"))


def test_running_totals_equal_a_global_window(spark):
    df = spark.range(0, 1_000, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(10_007)).alias("o"), "id")
    got = with_running_totals(df, [F.asc("o"), F.asc("id")], {"total": F.col("id")}).collect()
    total, want = 0, {}
    for row in sorted(df.collect(), key=lambda r: (r["o"], r["id"])):
        total += row["id"]
        want[row["id"]] = total
    assert {r["id"]: r["total"] for r in got} == want


def test_row_numbers_are_dense(spark):
    df = spark.range(0, 500, 1, 5).select((-F.col("id")).alias("x"))
    got = with_row_number(df, [F.desc("x")], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 501))
    assert {r["x"]: r["n"] for r in got}[0] == 1


def test_hot_keys(spark):
    assert hot_keys(skewed(spark), "k", 0.05) == [7]
    assert hot_keys(spark.range(5_000).withColumnRenamed("id", "k"), "k", 0.05) == []
    assert hot_keys(spark.createDataFrame([(None,)] * 9 + [(1,)], "k int"), "k", 0.05) == [1]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("max_broadcast_rows", [100_000, 1])
def test_split_join_equals_plain_join(spark, how, max_broadcast_rows):
    left = skewed(spark).unionByName(spark.createDataFrame([(None, -1)], "k bigint, v bigint"))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (101, "c"), (None, "d")], "rk bigint, name string")
    got = join_split_hot(left, right, "k", "rk", how, salts=5, max_broadcast_rows=max_broadcast_rows)
    plain = left.join(right, F.col("k") == F.col("rk"), how)
    order = ["v", "name"]
    assert got.orderBy(*order).collect() == plain.select(*got.columns).orderBy(*order).collect()


def test_bucketed_table_with_a_hot_key(spark, tmp_path):
    df = skewed(spark)
    spark.sql("DROP TABLE IF EXISTS hot_buckets")
    catalog.write_bucketed(df, "hot_buckets", key="k", buckets=4, path=str(tmp_path / "t"))
    assert sorted(spark.table("hot_buckets").collect()) == sorted(df.collect())
    spark.sql("DROP TABLE hot_buckets")


def test_bucketed_join_needs_no_exchange(spark, sf, tmp_path):
    catalog.write_bucketed(
        read(spark, sf, "lineitem"), "b_items", key="l_orderkey", buckets=4, path=str(tmp_path / "i")
    )
    catalog.write_bucketed(read(spark, sf, "orders"), "b_orders", key="o_orderkey", buckets=4, path=str(tmp_path / "o"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = joins.bucketed_left_join(
            spark.table("b_items"), spark.table("b_orders"), "l_orderkey", "o_orderkey"
        )
        plan = final_plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_items")
        spark.sql("DROP TABLE b_orders")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_size_checks(spark):
    df = spark.range(10)
    assert has_at_most(df, 10) and not has_at_most(df, 9)
    assert len(bounded_rows(df, 10, "rows")) == 10
    with pytest.raises(TooManyRows):
        bounded_rows(df, 9, "rows")


def test_checkpoint_folder_comes_from_the_session(spark):
    assert lineage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert lineage.scratch_path(spark, "x") != lineage.scratch_path(spark, "x")
    assert lineage.cut_lineage(spark.range(3)).count() == 3


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [float(i % 7) for i in range(2_000)],
        [42.0] * 700 + [float(i) for i in range(1_300)],
        [(-1.0) ** i * 1.7**(i % 90) for i in range(1_500)],
        [1.0] * 1_999 + [9.0],
        [42.0] * 2_500 + [float(i * i % 5_003) for i in range(5_000)],
    ],
)
def test_exact_quantiles(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, "x", probabilities, leaf_rows=20)
    assert got == pytest.approx(list(np.quantile(values, probabilities)))


def test_a_bad_bracket_does_not_change_the_quantile(spark, monkeypatch):
    from deedscope.operators import quantiles

    monkeypatch.setattr(quantiles, "_ends", lambda at: [0.4, 0.41])
    df = spark.range(3_000).select(F.col("id").cast("double").alias("x"))
    got = quantiles.exact_quantiles(df, "x", [0.1, 0.9], leaf_rows=700)
    assert got == pytest.approx([299.9, 2699.1])


def test_exact_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


@pytest.mark.parametrize("name", ["null_percentages", "hll_profile", "describe_numeric"])
def test_profiles_read_the_table_once(spark, sf, name):
    plan = final_plan(QUERIES[name](spark, sf)).split("== Initial Plan ==")[0]
    assert plan.count("orders.parquet") + plan.count("lineitem.parquet") == 1


PYTHON_ALLOWED = {
    "knn_l2_top3", "retrieve_context", "cubic_trend", "smoothed_forecast", "seasonal_errors", "lorentz_fit", "lorentz_curve", "lorentz_facts",
    "forecast_months",
}
COSTLY = {"combined_forecast", "gbt_trend", "forest_auc", "forest_scores"}


def test_plans_hold_no_cross_join_and_no_python(spark, sf):
    for name, query in QUERIES.items():
        if name in COSTLY:
            continue
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        if name not in PYTHON_ALLOWED:
            assert "EvalPython" not in plan and "InPandas" not in plan, name


def test_unequal_buckets_meet_without_an_exchange(spark, tmp_path):
    from deedscope.sources import catalog

    rows = spark.range(2_000).selectExpr("id % 300 AS k", "id AS v").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) k, -1L v"))
    for buckets in (4, 16):
        catalog.write_bucketed(rows.withColumnRenamed("k", f"k{buckets}"), f"in_{buckets}", key=f"k{buckets}", buckets=buckets, path=str(tmp_path / str(buckets)))
    few, many = spark.table("in_4"), spark.table("in_16").drop("v")
    want = rows.alias("a").join(rows.alias("b"), F.col("a.k") == F.col("b.k"), "left").count()
    for ratio, exchanges in ((4, 0), (2, 1)):
        joined = joins.unequal_buckets_join(few, many, "k4", "k16", ratio=ratio)
        plan = final_plan(joined).split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == exchanges and joined.count() == want
    spark.conf.unset("spark.sql.bucketing.coalesceBucketsInJoin.enabled")
    spark.sql("DROP TABLE in_4")
    spark.sql("DROP TABLE in_16")


def test_wide_features_keep_labels_off_the_driver(spark):
    from deedscope.operators import models

    rows = spark.range(3_000).selectExpr("id", "concat('label ', id % 1500) AS name", "IF(id % 7 = 0, NULL, id % 3) AS few", "double(id % 5) AS x")
    done = models.wide_features(rows, ["name", "few"], ["x"])
    cells = models.vector_cells(done, ["id"])
    assert done.count() == rows.filter("few IS NOT NULL").count()
    assert {r.size for r in done.select(F.unwrap_udt("features")["size"].alias("size")).distinct().collect()} == {1_499 + 2 + 1}
    got = {r["id"]: sorted(map(tuple, r["c"])) for r in cells.groupBy("id").agg(F.collect_list(F.struct("position", "value")).alias("c")).collect()}
    assert max(map(len, got.values())) == 3
    # Labels of two rows each are numbered by name; of the three values the one with fewest rows has no place.
    names = sorted(f"label {i}" for i in range(1_500))
    place = {name: i for i, name in enumerate(names)}
    for i, found in list(got.items())[:200]:
        positions = [p for p, _ in found]
        if place[f"label {i % 1500}"] < 1_499:
            assert place[f"label {i % 1500}"] in positions
        assert ((1_501, float(i % 5)) in found) == (i % 5 > 0)


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = final_plan(QUERIES["keyword_products"](spark, sf))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
    dear = read(spark, sf, "orders").filter(F.col("o_totalprice") > 400_000).select("o_orderkey")
    assert "GreaterThan(o_totalprice,400000.0)" in final_plan(dear)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 2, 4, 4)], "x double")
    rows = profiling.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["num_rows"] for r in rows] == [1, 2, 1, 2]
    assert rows[0]["left_edge"] == 0 and rows[-1]["right_edge"] == 4
    single = profiling.histogram(spark.createDataFrame([(3.0,)], "x double"), "x", 3).collect()
    assert sum(r["num_rows"] for r in single) == 1 and len(single) == 3
    assert profiling.histogram(df.filter("x > 9"), "x", 3).collect() == []


def test_declared_schemas_are_those_of_the_files(spark, sf):
    for table in SCHEMAS:
        assert read(spark, sf, table).dtypes == spark.read.parquet(f"{sf}/{table}.parquet").dtypes


def test_dates_survive(spark):
    df = spark.createDataFrame([(datetime.date(2024, 2, 29),)], "d date")
    assert profiling.profile_columns(df).first()["data_type"] == "date"


@pytest.mark.parametrize(
    "name, most", [("offshore_report", 0), ("most_expensive", 1), ("explore", 2), ("column_profile", 0), ("unscorable_anti", 1)]
)
def test_reports_read_the_ledger_seldom(spark, sf, name, most):
    """Scans of orders in the plan that is left, besides the one that a kept copy took."""
    plan = final_plan(QUERIES[name](spark, sf)).split("== Initial Plan ==")[0]
    assert plan.count("orders.parquet") <= most + (1 if name == "offshore_report" else 0)


def _shuffle_files(spark) -> int:
    """Files of shuffles that the session's own process holds."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return files.toString().count("/shuffle_")


def test_copies_leave_no_shuffle_files_behind(spark):
    rows = spark.range(5_000).withColumn("k", F.col("id") % 50)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(setting)
    for copy in (lineage.cut_lineage, lambda df: lineage.rewritten(df, "copies")):
        grouped = rows.groupBy("k").agg(F.sum("id").alias("n"))
        before = _shuffle_files(spark)
        copied = copy(grouped)
        for _ in range(50):  # files go a little later
            if _shuffle_files(spark) <= before:
                break
            time.sleep(0.1)
        assert _shuffle_files(spark) <= before
        # Neither the copy nor what it was made of needs them.
        assert copied.agg(F.sum("n")).first()[0] == grouped.agg(F.sum("n")).first()[0] == 4_999 * 2_500
    assert spark.conf.get(setting) == own
