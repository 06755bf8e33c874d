"""Catalog scans, written tables, bucketed joins and streams run to their end."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from deedscope.operators import joins
from deedscope.plans.lineage import scratch_path
from deedscope.sources import catalog, files, generate
from deedscope.streaming import microbatch
from deedscope.workload.registry import query
from deedscope.workload.tables import SCHEMAS, price_index, read, registry, rounded, rounded_sql, with_views


def _external(spark, sf: str, table: str) -> str:
    """Declare a given table in the catalog, over its own file; nothing is copied."""
    name = f"given_{table}_{hashlib.md5(sf.encode()).hexdigest()[:8]}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMAS[table]}) USING parquet LOCATION '{sf}/{table}.parquet'"
    )
    return name


def _table_name(label: str) -> str:
    return f"{label}_work"


@query("guarded_scan_count", "SELECT count(*) AS num_rows, count(*) FILTER (o_totalprice > 400000) AS dear_rows FROM orders")
def guarded_scan_count(spark, sf):
    orders = catalog.scan_table(spark, _external(spark, sf, "orders"))
    return orders.agg(F.count("*").alias("num_rows"), F.count_if(F.col("o_totalprice") > 400_000).alias("dear_rows"))


@query(
    "guarded_scan_pair",
    "SELECT (SELECT count(*) FROM orders) AS good_rows, (SELECT count(*) FROM customer) AS bad_rows",
)
def guarded_scan_pair(spark, sf):
    good, bad = catalog.scan_pair(spark, _external(spark, sf, "orders"), _external(spark, sf, "customer"))
    bad_rows = bad.agg(F.count("*").alias("n")).scalar()
    return good.agg(F.count("*").alias("good_rows")).select("good_rows", bad_rows.alias("bad_rows"))


def _rewritten(spark, df, label: str):
    """Write to a fresh external table in the shared folder and read it back."""
    table = _table_name(label)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    df.write.mode("overwrite").option("path", scratch_path(spark, label)).saveAsTable(table)
    return spark.table(table)


@query("table_round_trip", with_views("SELECT * FROM registry", "registry"))
def table_round_trip(spark, sf):
    return _rewritten(spark, registry(spark, sf), "ledger")


@query(
    "summary_round_trip",
    with_views(
        f"""SELECT strftime(date_taken, '%Y-%m-%d') AS Date_Taken, region_name AS Region_Name, {rounded_sql("average_price")} AS Average_Price,
          (year(date_taken) * 100 + month(date_taken))::INT AS year_month FROM price_index""",
        "price_index",
    ),
)
def summary_round_trip(spark, sf):
    from deedscope.functions.scalars import year_month
    from deedscope.operators.cleaning import clean_names, conform

    named = price_index(spark, sf).select(
        F.date_format("date_taken", "yyyy-MM-dd").alias("Date Taken"),
        F.col("region_name").alias("Region Name"),
        rounded("average_price").alias("Average Price"),
        year_month("date_taken").alias("year_month"),
    )
    schema = "Date_Taken STRING, Region_Name STRING, Average_Price DOUBLE, year_month INT"
    return _rewritten(spark, conform(clean_names(named), schema), "summary")


@query("parquet_round_trip", "SELECT * FROM events")
def parquet_round_trip(spark, sf):
    path = scratch_path(spark, "events")
    files.write_parquet(read(spark, sf, "events"), path)
    return files.read_parquet(spark, path)


@query("created_table", "SELECT o_orderpriority, count(*) AS num_rows, max(o_totalprice) AS highest FROM orders GROUP BY 1")
def created_table(spark, sf):
    source, table = _external(spark, sf, "orders"), _table_name("problem_rows")
    catalog.create_table_as(
        spark, table,
        f"SELECT o_orderpriority, count(*) AS num_rows, max(o_totalprice) AS highest FROM {source} GROUP BY o_orderpriority",
    )
    return spark.table(table)


def _bucketed(spark, df, label: str, key: str, partition_by=()):
    table = _table_name(label)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    catalog.write_bucketed(
        df, table, key=key, buckets=catalog.buckets_for(df), partition_by=partition_by, path=scratch_path(spark, table)
    )
    return spark.table(table)


_CUSTOMER_ORDERS = """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey"""


def _bucketed_pair(spark, sf):
    """Customers, some of them without an order, and all orders, in the same number of buckets."""
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    customers, buckets = read(spark, sf, "customer").select("c_custkey", "c_name"), catalog.buckets_for(orders)
    tables = []
    for label, df, key in (("bucketed_customers", customers, "c_custkey"), ("bucketed_orders", orders, "o_custkey")):
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(label)}")
        catalog.write_bucketed(df, _table_name(label), key=key, buckets=buckets, path=scratch_path(spark, label))
        tables.append(spark.table(_table_name(label)))
    return tables


@query("bucketed_left_join", _CUSTOMER_ORDERS)
def bucketed_left_join(spark, sf):
    return joins.bucketed_left_join(*_bucketed_pair(spark, sf), "c_custkey", "o_custkey").drop("o_custkey")


@query("unequal_buckets_join", _CUSTOMER_ORDERS)
def unequal_buckets_join(spark, sf):
    """Four buckets of customers against sixteen of orders: four of those are read as one."""
    tables = []
    for table, columns, key, buckets in (
        ("customer", ["c_custkey", "c_name"], "c_custkey", 4), ("orders", ["o_custkey", "o_orderkey", "o_totalprice"], "o_custkey", 16),
    ):
        name = f"{table}_in_{buckets}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        catalog.write_bucketed(read(spark, sf, table).select(*columns), name, key=key, buckets=buckets, path=scratch_path(spark, name))
        tables.append(spark.table(name))
    return joins.unequal_buckets_join(*tables, "c_custkey", "o_custkey", ratio=4).drop("o_custkey")


@query("broadcast_left_join", _CUSTOMER_ORDERS)
def broadcast_left_join(spark, sf):
    customers, orders = _bucketed_pair(spark, sf)
    joined = joins.bucketed_left_join(
        customers, orders, "c_custkey", "o_custkey", broadcast_bytes=16 << 20, order_by=["c_custkey", "o_orderkey"]
    )
    return joined.drop("o_custkey")


@query(
    "partitioned_left_join",
    """SELECT l_orderkey, l_linenumber, l_returnflag, o_orderkey, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R'""",
)
def partitioned_left_join(spark, sf):
    """One partition of the larger table against the other, bucketed alike: the rest is not read."""
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    left = _bucketed(spark, items, "items_by_flag", "l_orderkey", ["l_returnflag"])
    right = _bucketed(spark, orders, "orders_by_key", "o_orderkey")
    return joins.bucketed_left_join(left.filter("l_returnflag = 'R'"), right, "l_orderkey", "o_orderkey")


@query(
    "partitioned_buckets",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
)
def partitioned_buckets(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return _bucketed(spark, orders, "bucketed_by_status", "o_orderkey", ["o_orderstatus"]).filter("o_orderstatus = 'F'")


@query(
    "hourly_columns",
    """SELECT o_orderkey, strftime(TIMESTAMP '2024-01-01' + to_hours(o_orderkey::INT), '%Y-%m-%d') AS dt,
      strftime(TIMESTAMP '2024-01-01' + to_hours(o_orderkey::INT), '%H') AS hr FROM orders""",
)
def hourly_columns(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", *generate.hourly_columns(F.col("o_orderkey")))


_UNIT_SQL = "(('0x' || substr(md5('{seed}|' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(
    "picked_keys",
    f"""SELECT o_orderkey AS id2, 'place-' || (floor(h * 1e6)::BIGINT % 1000) AS small_feature_1, {_UNIT_SQL.format(seed=43)} * 50 AS small_feature_2,
      strftime(TIMESTAMP '2024-01-01' + to_hours(n::INT), '%Y-%m-%d') AS dt, strftime(TIMESTAMP '2024-01-01' + to_hours(n::INT), '%H') AS hr
    FROM (SELECT o_orderkey, h, row_number() OVER (ORDER BY h, o_orderkey) - 1 AS n
      FROM (SELECT o_orderkey, {_UNIT_SQL.format(seed=42)} AS h FROM orders)) WHERE n < 500""",
)
def picked_keys(spark, sf):
    return generate.small_table(read(spark, sf, "orders"), 500, "o_orderkey")


def _streamed(spark, sf):
    schema = read(spark, sf, "events").schema
    stream = microbatch.file_stream(spark, sf, schema, pattern="events.parquet")
    squared = microbatch.with_square(stream.select("event_id", "ts", "event_type"), "event_id")
    output = scratch_path(spark, "enriched")
    job = microbatch.run_enrichment(
        squared,
        lambda batch: microbatch.with_prompt(batch, "event_id"),
        output=output,
        checkpoint=scratch_path(spark, "stream-checkpoint"),
    )
    job.awaitTermination()
    return spark.read.parquet(output)


@query(
    "stream_square",
    """SELECT event_id, event_type, CAST(event_id * event_id AS BIGINT) AS value_squared,
      'The value is ' || event_id || ' and its square is ' || (event_id * event_id) ||
      '. Provide some interesting insights or context about these numbers.' AS prompt FROM events""",
)
def stream_square(spark, sf):
    return _streamed(spark, sf).select(
        "event_id", "event_type", F.col("value_squared").cast("bigint").alias("value_squared"), "prompt"
    )


_BATCH_ROWS, _BATCHES = 150, 3


@query(
    "stream_lookup",
    f"SELECT event_id AS value, event_type, user_id FROM events WHERE event_id < {_BATCH_ROWS * _BATCHES}",
)
def stream_lookup(spark, sf):
    """A numbered stream joined to the events, a batch at a start: each start goes on where the last one ended."""
    output, checkpoint = scratch_path(spark, "lookup"), scratch_path(spark, "lookup-checkpoint")
    events = read(spark, sf, "events").select("event_id", "event_type", "user_id")
    for _ in range(_BATCHES):
        numbers = generate.numbered_stream(spark, _BATCH_ROWS, partitions=2).select("value")
        found = microbatch.looked_up(numbers, events, "value", "event_id")
        microbatch.run_enrichment(found, lambda batch: batch, output=output, checkpoint=checkpoint).awaitTermination()
    return spark.read.parquet(output).select("value", "event_type", "user_id")


# --- files and views, each written from a given table and read back --------------------------------


@query("delimited_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def delimited_round_trip(spark, sf):
    path = scratch_path(spark, "delimited")
    read(spark, sf, "customer").write.csv(path, sep="\t", header=True)
    return files.read_delimited(spark, path, SCHEMAS["customer"])


@query("inferred_round_trip", "SELECT s_suppkey::INT AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def inferred_round_trip(spark, sf):
    path = scratch_path(spark, "inferred")
    read(spark, sf, "supplier").write.csv(path, header=True)
    return files.read_csv_inferred(spark, path)


@query("lines_round_trip", "SELECT c_name AS value FROM customer")
def lines_round_trip(spark, sf):
    path = scratch_path(spark, "lines")
    read(spark, sf, "customer").select(F.col("c_name").alias("value")).write.text(path)
    return files.read_lines(spark, path)


@query("parallel_arrays", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def parallel_arrays(spark, sf):
    """Documents of parallel arrays, one for each hundred customers."""
    path, columns = scratch_path(spark, "arrays"), {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"}
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    documents = read(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("part")).agg(rows.alias("r"))
    arrays = documents.select(*[F.col(f"r.{c}").alias(c) for c in columns])
    arrays.write.option("maxRecordsPerFile", 1).json(path)
    return files.read_parallel_arrays(spark, path, columns)


@query("clean_names_table", "SELECT c_custkey AS Customer_Key, c_acctbal AS Balance_GBP FROM customer")
def clean_names_table(spark, sf):
    table = _table_name("clean_names")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("Customer Key"), F.col("c_acctbal").alias("Balance GBP"))
    catalog.write_clean_table(rows, table)
    return spark.table(table)


@query("single_csv_report", "SELECT c_mktsegment, count(*)::INT AS num_rows FROM customer GROUP BY c_mktsegment")
def single_csv_report(spark, sf):
    path = scratch_path(spark, "report")
    files.write_single_csv(read(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("num_rows")), path)
    return files.read_csv_inferred(spark, path)


@query("registered_view", "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY o_orderpriority")
def registered_view(spark, sf):
    catalog.register_views(ledger_view=read(spark, sf, "orders"))
    return spark.sql("SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean_price FROM ledger_view GROUP BY o_orderpriority")


@query("flag_column", "SELECT c_custkey, 1 AS is_fraud FROM customer")
def flag_column(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.lit(1).alias("is_fraud"))


@query(
    "columns_with_values",
    with_views("SELECT title_number, price_paid, tenure, country FROM registry WHERE price_paid > 300000", "registry"),
)
def columns_with_values(spark, sf):
    """Of the rows of a subset, the columns that have any value there."""
    rows = registry(spark, sf).filter("price_paid > 300000").select("title_number", "price_paid", "tenure", "country")
    from deedscope.operators.cleaning import drop_empty_columns

    return drop_empty_columns(rows.withColumn("never", F.when(F.col("price_paid") < 0, 1)))


@query("capped_rows", "SELECT least(count(*), 1000) AS num_rows FROM orders")
def capped_rows(spark, sf):
    from deedscope.operators.sampling import cap_rows

    return cap_rows(read(spark, sf, "orders"), 1_000).agg(F.count("*").alias("num_rows"))
