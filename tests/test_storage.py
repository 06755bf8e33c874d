"""Sources, sinks and streams over local files."""

import json

import pytest
from pyspark.sql import functions as F

from deedscope.plans.sizing import TooManyRows
from deedscope.sources import catalog, connectors, files, generate
from deedscope.streaming import microbatch


def test_guarded_scan(spark):
    with pytest.raises(LookupError):
        catalog.scan_table(spark, "no_such_table")
    catalog.write_table(spark.range(5), "five")
    assert catalog.scan_table(spark, "five", statistics="rows").count() == 5
    assert catalog.schema_exists(spark, "DEFAULT") and not catalog.schema_exists(spark, "nope")
    good, bad = catalog.scan_pair(spark, "five", "five")
    assert good.count() == bad.count() == 5
    spark.sql("DROP TABLE five")


def test_write_clean_table_with_schema(spark):
    df = spark.createDataFrame([("1", 2)], "`Price Paid` string, `a/b` int")
    catalog.write_clean_table(df, "clean_one", schema="Price_Paid INT, a_b BIGINT")
    assert spark.table("clean_one").dtypes == [("Price_Paid", "int"), ("a_b", "bigint")]
    spark.sql("DROP TABLE clean_one")


def test_create_table_as_replaces(spark):
    for n in (3, 4):
        columns = catalog.create_table_as(spark, "made", f"SELECT id FROM range({n})")
    assert columns == [("id", "bigint")] and spark.table("made").count() == 4
    spark.sql("DROP TABLE made")


def test_partitioned_bucket_table(spark, tmp_path):
    large = generate.large_table(spark, 100)
    catalog.write_bucketed(large, "hours", key="id1", buckets=2, partition_by=["dt", "hr"], path=str(tmp_path / "h"))
    one_day = spark.table("hours").filter("dt = '2024-01-02'")
    assert one_day.count() == 24
    one_day.collect()
    assert "PartitionFilters: [isnotnull(dt" in one_day._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE hours")


def test_text_table(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n")
    assert catalog.create_text_table(spark, "lines_of_text", str(tmp_path / "t")).count() == 2
    assert files.read_lines(spark, str(tmp_path / "t")).columns == ["value"]
    spark.sql("DROP TABLE lines_of_text")


def test_delimited(spark, tmp_path):
    path = tmp_path / "cards.tsv"
    path.write_text("transaction_id\tamount\tmerchant\tcategory\tis_fraud\n1\t9.5\tm\tc\ttrue\n")
    row = files.read_delimited(spark, str(path)).first()
    assert (row["amount"], row["is_fraud"]) == (9.5, True)
    inferred = tmp_path / "p.csv"
    inferred.write_text("id,description\n1,Nike shoe\n")
    assert files.read_csv_inferred(spark, str(inferred)).dtypes == [("id", "int"), ("description", "string")]


def test_parallel_arrays(spark, tmp_path):
    columns = {"DateTaken": "date", "Average Price": "double"}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"DateTaken": ["2024-01-01", "2024-02-01"], "Average Price": [1.5, 2.5]}, indent=1))
    bad.write_text(json.dumps({"DateTaken": ["2024-01-01"], "Average Price": [1.5, 2.5]}))
    df = files.read_parallel_arrays(spark, str(good), columns)
    assert [(r[0].month, r[1]) for r in df.collect()] == [(1, 1.5), (2, 2.5)]
    with pytest.raises(Exception, match="differ in length"):
        files.read_parallel_arrays(spark, str(bad), columns).collect()


def test_json_record(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"TitleNumber": "BGL35462", "features": [5275000.0]}, indent=2))
    row = files.read_json_records(spark, str(path), "TitleNumber string, features array<double>").first()
    assert row["features"] == [5275000.0]


def test_single_csv(spark, tmp_path):
    df = spark.createDataFrame([("Jersey", 12.5), ("Guernsey", 7.0)], "name string, share double")
    path = tmp_path / "out"
    files.write_single_csv(files.share_lines(df, "name", "share"), str(path))
    parts = list(path.glob("part-*.csv"))
    assert len(parts) == 1 and "Jersey\t12.5%" in parts[0].read_text()
    with pytest.raises(TooManyRows):
        files.write_single_csv(spark.range(10), str(path), max_rows=5)


def test_parquet(spark, tmp_path):
    files.write_parquet(spark.range(3), str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p")).count() == 3


def test_views(spark):
    catalog.register_views(good_rows=spark.range(2))
    assert spark.sql("SELECT count(*) FROM good_rows").first()[0] == 2


# The stores need a server or a connector jar, so only the options are checked.


def test_jdbc_options():
    store = connectors.jdbc(
        "jdbc:x", "t", "u", "p", "D", fetch_size=1000, split_column="id", bounds=(0, 99), splits=8
    )
    assert store.format == "jdbc"
    assert store.options == {
        "url": "jdbc:x", "dbtable": "t", "user": "u", "password": "p", "driver": "D", "fetchsize": "1000",
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "99", "numPartitions": "8",
    }
    with pytest.raises(ValueError):
        connectors.jdbc("jdbc:x", "t", "u", "p", "D", split_column="id")


def test_other_store_options():
    assert connectors.bigquery("d", "t", "/key.json") == connectors.Store(
        "bigquery", {"credentialsFile": "/key.json", "dataset": "d", "table": "t"}
    )
    redis = connectors.redis("t", "id", infer_schema=True)
    assert redis.format == "org.apache.spark.sql.redis"
    assert redis.options == {"table": "t", "key.column": "id", "infer.schema": "true"}


class Recorder:
    """Stands in for a reader or writer and records what it was told."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return self

        return call


def test_store_reader_and_writer_pass_the_options():
    class Holder:
        def __init__(self):
            self.read = self.write = Recorder()

    store = connectors.jdbc("jdbc:x", "t", "u", "p", "D", fetch_size=10)
    reading, writing = Holder(), Holder()
    with pytest.raises(ValueError):
        connectors.read_store(reading, store)
    connectors.read_store(reading, store, one_task=True)
    connectors.write_store(writing, store, "overwrite")
    assert [c[0] for c in reading.read.calls] == ["format", "options", "load"]
    assert reading.read.calls[1][2]["fetchsize"] == "10"
    assert "fetchsize" not in writing.write.calls[1][2]
    assert writing.write.calls[2][1] == ("overwrite",)


# --- generated tables -----------------------------------------------------------------------------


def test_generated_pair(spark):
    large = generate.large_table(spark, 1_000)
    assert large.columns == ["id1", "feature_1", "feature_2", "dt", "hr"]
    assert tuple(large.orderBy("id1").collect()[25])[3:] == ("2024-01-02", "01")
    small = generate.small_table(large, 100)
    ids = [r["id2"] for r in small.collect()]
    assert len(set(ids)) == 100 and set(ids) <= set(range(1, 1_001))
    assert small.agg(F.countDistinct("dt", "hr")).first()[0] == 100


# --- streams -------------------------------------------------------------------------------------------


def test_rate_stream(spark):
    stream = microbatch.with_square(generate.rate_stream(spark, 1), "value")
    assert stream.isStreaming and stream.columns == ["timestamp", "value", "value_squared"]


def test_stream_restart_adds_no_duplicates(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.range(0, 10).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        stream = microbatch.with_square(microbatch.file_stream(spark, source, schema, files_per_batch=1), "id")
        microbatch.run_enrichment(
            stream, lambda b: microbatch.with_prompt(b, "id", "value_squared"), output=output, checkpoint=checkpoint
        ).awaitTermination()

    run()
    run()
    assert spark.read.parquet(output).count() == 10
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(source)
    run()
    rows = {r["id"]: r for r in spark.read.parquet(output).collect()}
    assert sorted(rows) == list(range(15)) and spark.read.parquet(output).count() == 15
    assert rows[12]["prompt"].startswith("The value is 12 and its square is 144.")


def test_numbered_stream_goes_on_after_a_restart(spark, tmp_path):
    table = spark.createDataFrame([(i, f"e{i}") for i in range(0, 60, 2)], "k long, name string")
    for start in range(4):
        stream = microbatch.looked_up(generate.numbered_stream(spark, 10, partitions=2), table, "value", "k", how="left")
        query = microbatch.run_enrichment(stream, lambda b: b, output=str(tmp_path / "out"), checkpoint=str(tmp_path / "check"))
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(r["value"] for r in rows) == list(range(10 * (start + 1)))
        assert all(r["name"] == (f"e{r['value']}" if r["value"] % 2 == 0 else None) for r in rows)


def test_console(spark, tmp_path):
    job = microbatch.to_console(generate.rate_stream(spark), checkpoint=str(tmp_path / "cp"))
    job.stop()
