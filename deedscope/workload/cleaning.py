"""Filters, clean-up and scalar functions on the ledger and other tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from deedscope.functions import scalars, sql_functions
from deedscope.operators import cleaning, joins, reports, sampling
from deedscope.workload.ledger import _STANDARD_SQL
from deedscope.workload.profiles import TEXTS
from deedscope.workload.registry import query
from deedscope.workload.tables import price_index, read, registry, rounded, rounded_sql, with_views

# --- filters ---------------------------------------------------------------------------------------


@query("rogue_filter", with_views("SELECT title_number, tenure FROM registry WHERE tenure <> '93347'", "registry"))
def rogue_filter(spark, sf):
    return cleaning.drop_rogue(registry(spark, sf), "tenure", "93347").select("title_number", "tenure")


@query(
    "range_filter",
    with_views(
        f"""SELECT region_name, date_taken, {rounded_sql("flat_price")} AS flat_price FROM price_index
        WHERE region_name = 'NATION_7' AND date_taken BETWEEN DATE '1996-03-01' AND DATE '1999-10-01'
          AND flat_price IS NOT NULL""",
        "price_index",
    ),
)
def range_filter(spark, sf):
    start, end = datetime.date(1996, 3, 1), datetime.date(1999, 10, 1)
    rows = cleaning.in_period(
        price_index(spark, sf), "region_name", "NATION_7", "date_taken", start, end, ["flat_price"]
    )
    return rows.select("region_name", "date_taken", rounded("flat_price").alias("flat_price"))


@query(
    "price_band",
    with_views(
        """SELECT title_number, price_paid FROM registry
        WHERE county = 'EUROPE' AND district = 'NATION_13' AND price_paid BETWEEN 100000 AND 450000""",
        "registry",
    ),
)
def price_band(spark, sf):
    rows = cleaning.in_price_band(registry(spark, sf), "EUROPE", "NATION_13", 100_000, 450_000)
    return rows.select("title_number", "price_paid")


_LISTED = ["ZZ3 1", "ZZ4 4", "ZZ5 9", "ZZ10 0", "ZZ21 7"]
_LISTED_SQL = ", ".join(f"'{x}'" for x in _LISTED)


@query("deny_list", with_views(f"SELECT title_number, postcode FROM registry WHERE postcode NOT IN ({_LISTED_SQL})", "registry"))
def deny_list(spark, sf):
    return cleaning.without_listed(registry(spark, sf), "postcode", _LISTED).select("title_number", "postcode")


@query("allow_list", with_views(f"SELECT title_number, postcode FROM registry WHERE postcode IN ({_LISTED_SQL})", "registry"))
def allow_list(spark, sf):
    return cleaning.only_listed(registry(spark, sf), "postcode", _LISTED).select("title_number", "postcode")


@query(
    "allow_list_table",
    with_views(
        """SELECT title_number, district FROM registry WHERE district IN
        (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 1000)""",
        "registry",
    ),
)
def allow_list_table(spark, sf):
    indebted = (
        read(spark, sf, "supplier")
        .filter(F.col("s_acctbal") < 1000)
        .join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("n_name")
    )
    return cleaning.only_listed(registry(spark, sf), "district", indebted).select("title_number", "district")


@query(
    "deny_list_table",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def deny_list_table(spark, sf):
    dear = read(spark, sf, "orders").filter(F.col("o_totalprice") > 400_000).select("o_custkey")
    return cleaning.without_listed(read(spark, sf, "customer"), "c_custkey", dear).select("c_custkey", "c_name")


@query(
    "unlabelled_documents",
    "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def unlabelled_documents(spark, sf):
    rest = joins.rows_without_match(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id")
    return rest.select("doc_id")


@query(
    "contains_rlike",
    with_views(
        """SELECT title_number, address1 FROM registry
        WHERE NOT contains(address1, 'Harbour') AND regexp_matches(address1, '(?i)ST.?HELIER')""",
        "registry",
    ),
)
def contains_rlike(spark, sf):
    rows = cleaning.without_substring(registry(spark, sf), "address1", "Harbour")
    return rows.filter(scalars.matches_ignoring_case("address1", "ST.?HELIER")).select("title_number", "address1")


@query("keyword_documents", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'license')")
def keyword_documents(spark, sf):
    return reports.keyword_search(read(spark, sf, "documents"), "text", "License").select("doc_id", "n_chars")


@query("keyword_products", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def keyword_products(spark, sf):
    return reports.keyword_search(read(spark, sf, "part"), "p_name", "RING").select("p_partkey", "p_name")


@query("sentinel_guard", with_views("SELECT title_number, district FROM registry WHERE coalesce(district, 'NULL') <> 'NULL'", "registry"))
def sentinel_guard(spark, sf):
    return cleaning.with_value(registry(spark, sf), "district").select("title_number", "district")


# --- clean-up ----------------------------------------------------------------------------------------


@query(
    "sanitize_strings",
    with_views(
        "SELECT price_paid, date_added, "
        + ", ".join(f"coalesce(trim(lower(regexp_replace({c}, '[.,;:!?()\\[\\]]', '', 'g'))), 'unknown') AS {c}" for c in TEXTS)
        + " FROM registry",
        "registry",
    ),
)
def sanitize_strings(spark, sf):
    return cleaning.clean_strings(registry(spark, sf))


@query("tidy_ledger", with_views("SELECT * EXCLUDE (proprietor2, region) REPLACE (CAST(price_paid AS DECIMAL(12, 1))::DOUBLE AS price_paid) FROM registry WHERE tenure <> '93347'", "registry"))
def tidy_ledger(spark, sf):
    tidy = cleaning.tidy_ledger(registry(spark, sf), casts={"price_paid": "decimal(12,1)"}, drop=["proprietor2", "region"])
    return tidy.withColumn("price_paid", F.col("price_paid").cast("double"))


@query("not_all_null_columns", with_views("SELECT title_number, price_paid FROM registry", "registry"))
def not_all_null_columns(spark, sf):
    rows = registry(spark, sf).select(
        "title_number", F.lit(None).cast("string").alias("proprietor4"), "price_paid", F.lit(None).cast("int").alias("units")
    )
    return cleaning.drop_empty_columns(rows)


@query(
    "sanitize_names",
    """SELECT r_regionkey AS Region_Key, r_name AS Name_percentand_number, r_regionkey + 1 AS NextRegion_
    FROM region""",
)
def sanitize_names(spark, sf):
    raw = read(spark, sf, "region").select(
        F.col("r_regionkey").alias("Region-Key"),
        F.col("r_name").alias("Name %& #(!)"),
        (F.col("r_regionkey") + 1).alias("Next.Region/"),
    )
    return cleaning.clean_names(raw)


@query("standardise_address", with_views(f"SELECT title_number, {_STANDARD_SQL} AS address FROM registry", "registry"))
def standardise_address(spark, sf):
    return registry(spark, sf).select("title_number", cleaning.standard_address("address1").alias("address"))


@query(
    "coerce_numeric",
    """SELECT TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, value FROM events
    WHERE value IS NOT NULL AND TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE regexp_extract(props, '[0-9]+') END AS DOUBLE) IS NOT NULL""",
)
def coerce_numeric(spark, sf):
    k = F.get_json_object("props", "$.k")
    rows = read(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(k).alias("k"), "value")
    return cleaning.coerce_numeric(rows, ["k", "value"])


@query("numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_columns(spark, sf):
    return cleaning.numeric_only(read(spark, sf, "orders"))


@query(
    "decode_table",
    """SELECT CASE r_regionkey WHEN 0 THEN 'WALSALL' WHEN 3 THEN 'DUDLEY' ELSE r_regionkey::DOUBLE::VARCHAR END AS district,
      n_nationkey AS price_paid, DATE '2020-01-01' + n_nationkey AS added, n_name
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def decode_table(spark, sf):
    encoded = read(spark, sf, "nation").select(
        F.col("n_regionkey").cast("double").alias("district"),
        (F.col("n_nationkey") + 0.4).alias("price_paid"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_nationkey")), "yyyy-MM-dd").alias("added"),
        "n_name",
    )
    return cleaning.decode_table(
        encoded,
        {"district": "string", "price_paid": "integer", "added": "date"},
        {"district": {0.0: "WALSALL", 3.0: "DUDLEY"}},
    )


@query(
    "union_all",
    "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier",
)
def union_all(spark, sf):
    first = read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return sampling.union_all(first, read(spark, sf, "supplier").select("s_name", "s_acctbal"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate::DATE AS shipped FROM lineitem")
def distinct_rows(spark, sf):
    rows = read(spark, sf, "lineitem")
    return rows.select("l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("shipped")).distinct()


# --- scalar functions ------------------------------------------------------------------------------------


@query(
    "string_fns",
    with_views(
        """SELECT title_number, lower(address1) AS lowered, upper(trim(county)) AS uppered, length(address1) AS len,
          lpad(postcode, 10, '*') AS padded_left, rpad(postcode, 10, '*') AS padded_right, substr(address1, 3, 12) AS part,
          coalesce(proprietor1, proprietor2, 'nobody') AS owner, repeat('-', 3) || tenure AS ruled,
          '£' || format('{:,.2f}', price_paid) AS amount,
          county || chr(9) || CAST(round(price_paid / 1000, 1) AS VARCHAR) || '%' AS line
        FROM registry""",
        "registry",
    ),
)
def string_fns(spark, sf):
    return registry(spark, sf).select(
        "title_number",
        F.lower("address1").alias("lowered"),
        F.upper(F.trim("county")).alias("uppered"),
        F.length("address1").cast("bigint").alias("len"),
        F.lpad("postcode", 10, "*").alias("padded_left"),
        F.rpad("postcode", 10, "*").alias("padded_right"),
        F.substr("address1", F.lit(3), F.lit(12)).alias("part"),
        F.coalesce("proprietor1", "proprietor2", F.lit("nobody")).alias("owner"),
        F.concat(F.repeat(F.lit("-"), 3), "tenure").alias("ruled"),
        scalars.pounds("price_paid").alias("amount"),
        scalars.share_line("county", F.round(F.col("price_paid") / 1000, 1)).alias("line"),
    )


@query(
    "date_fns",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
      year(o_orderdate) * 100 + month(o_orderdate) AS yyyymm, strftime(o_orderdate, '%d/%m/%Y') AS british,
      CAST(o_orderdate AS DATE) AS parsed, CAST(o_orderdate AS DATE) AS parsed_british,
      (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS month_no FROM orders""",
)
def date_fns(spark, sf):
    date = F.col("o_orderdate").cast("date")
    british = F.date_format(date, "dd/MM/yyyy")
    return read(spark, sf, "orders").select(
        "o_orderkey",
        F.year(date).cast("bigint").alias("y"),
        F.month(date).cast("bigint").alias("m"),
        F.dayofmonth(date).cast("bigint").alias("d"),
        scalars.year_month(date).cast("bigint").alias("yyyymm"),
        british.alias("british"),
        scalars.parse_date(F.date_format(date, "yyyy-MM-dd")).alias("parsed"),
        scalars.parse_date(british, "dd/MM/yyyy").alias("parsed_british"),
        scalars.month_index(date, F.lit(datetime.date(1995, 1, 1))).cast("bigint").alias("month_no"),
    )


@query(
    "math_fns",
    f"""SELECT l_orderkey, l_linenumber, {rounded_sql("l_extendedprice / l_quantity")} AS ratio, floor(l_extendedprice)::BIGINT AS floored,
      CASE WHEN l_tax > 0.04 THEN 'high' WHEN l_tax > 0 THEN 'low' ELSE 'none' END AS band, (l_returnflag = 'R')::INT AS returned,
      greatest(10.0, least(l_quantity, 40.0)) AS clipped, CAST(l_orderkey * l_orderkey AS BIGINT) AS squared,
      CASE l_linestatus WHEN 'F' THEN 'filled' ELSE l_linestatus END AS status FROM lineitem""",
)
def math_fns(spark, sf):
    return read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        rounded(F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"),
        F.floor("l_extendedprice").alias("floored"),
        F.when(F.col("l_tax") > 0.04, "high").when(F.col("l_tax") > 0, "low").otherwise("none").alias("band"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        scalars.clip("l_quantity", 10.0, 40.0).alias("clipped"),
        scalars.square("l_orderkey").cast("bigint").alias("squared"),
        scalars.map_values("l_linestatus", {"F": "filled"}).alias("status"),
    )


@query(
    "array_fns",
    """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / 255)), 9) AS scaled_sum,
      round(embedding[3]::DOUBLE, 6) AS third, embedding[1000]::DOUBLE AS beyond,
      round(list_aggregate(embedding::DOUBLE[], 'stddev_pop'), 6) AS spread FROM embeddings""",
)
def array_fns(spark, sf):
    vector = F.col("embedding").cast("array<double>")
    total = F.aggregate(scalars.scale_array("v", 255.0), F.lit(0.0), lambda acc, x: acc + x)
    return read(spark, sf, "embeddings").select("vec_id", vector.alias("v")).select(
        "vec_id",
        F.round(total, 9).alias("scaled_sum"),
        F.round(scalars.element_or_null("v", 2), 6).alias("third"),
        scalars.element_or_null("v", 999).alias("beyond"),
        F.round(sql_functions.stddev_of_array("v"), 6).alias("spread"),
    )


@query(
    "udf_builtins",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, substr(event_type, 2, 3) AS part,
      floor(event_id - 1) / 50.0::DOUBLE AS clustered, (event_id - 1) / 50.0::DOUBLE AS clustered_exact,
      (((event_id - 1) % 50 + 50) % 50)::DOUBLE AS scattered, '1234' || event_id AS padded, repeat('x', 4) AS filled,
      TRY_CAST(trunc(value) AS INT) AS whole, TRY_CAST(event_type AS INT) AS no_number FROM events""",
)
def udf_builtins(spark, sf):
    f = sql_functions
    return read(spark, sf, "events").select(
        "event_id",
        f.timestamp_text("ts").alias("at"),
        f.substring_between("event_type", 2, 4).alias("part"),
        f.clustered("event_id", 50).alias("clustered"),
        f.clustered_exact("event_id", 50).alias("clustered_exact"),
        f.scattered("event_id", 50).alias("scattered"),
        f.pad_sequence("event_id", 4).alias("padded"),
        f.pad_single(F.lit("x"), 4).alias("filled"),
        f.to_int("value").alias("whole"),
        f.to_int("event_type").alias("no_number"),
    )


@query("random_functions")
def random_functions(spark, sf):
    f = sql_functions
    return read(spark, sf, "events").select(
        "event_id",
        f.random_text(8, 1).alias("text"),
        f.randomised("event_id", 50, 7).alias("randomised"),
        f.randomised_normal(50, 7).alias("normal"),
        f.pad_random("event_id", 12, 3).alias("padded"),
    )


# Three peaks of an earlier monthly fit, as (height, centre, half width).
_PEAKS = [(4.0, 1996.0, 1.5), (2.5, 1998.0, 0.75), (3.0, 2000.5, 1.25)]


@query(
    "lorentz_eval",
    "SELECT o_orderkey, round("
    + " + ".join(f"{h} * {w} * {w} / (power(year(o_orderdate) + month(o_orderdate) / 12.0::DOUBLE - {c}, 2) + {w} * {w})" for h, c, w in _PEAKS)
    + ", 6) AS curve FROM orders",
)
def lorentz_eval(spark, sf):
    at = F.year("o_orderdate") + F.month("o_orderdate") / F.lit(12.0)
    return read(spark, sf, "orders").select("o_orderkey", F.round(scalars.lorentzian(at, _PEAKS), 6).alias("curve"))


# --- size lines ---------------------------------------------------------------------------------------------

# Line items as size lines: quantity and unit, then a release made of the supplier and part keys.
_LINES_SQL = """SELECT (CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END) || CAST(l_quantity AS VARCHAR)
  || (CASE WHEN l_returnflag = 'R' THEN 'G' ELSE 'M' END) || ' ./' || (l_suppkey % 7) || '.' || (l_partkey % 10) || '.0' AS value
FROM lineitem"""


def _size_lines(spark, sf):
    return read(spark, sf, "lineitem").select(
        F.concat(
            F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(""),
            F.col("l_quantity").cast("string"),
            F.when(F.col("l_returnflag") == "R", "G").otherwise("M"),
            F.lit(" ./"),
            F.col("l_suppkey") % 7,
            F.lit("."),
            F.col("l_partkey") % 10,
            F.lit(".0"),
        ).alias("value")
    )


@query(
    "release_sizes",
    f"""WITH lines AS ({_LINES_SQL}),
      parsed AS (SELECT regexp_extract(value, '\\./([0-9]+)\\.', 1) AS major_release,
        CAST(regexp_extract(value, '([0-9.]+)[MG]', 1) AS DOUBLE) * CASE WHEN contains(value, 'G') THEN 1024 ELSE 1 END AS mb FROM lines)
    SELECT major_release, round(sum(mb), 2) AS total_megabytes FROM parsed GROUP BY 1
    UNION ALL SELECT 'Total', round(sum(mb), 2) FROM parsed""",
)
def release_sizes(spark, sf):
    return reports.size_totals(_size_lines(spark, sf))


@query(
    "conform_schema",
    with_views("SELECT title_number, floor(price_paid)::BIGINT AS price_paid, TRY_CAST(tenure AS INT) AS tenure FROM registry", "registry"),
)
def conform_schema(spark, sf):
    rows = registry(spark, sf).withColumn("price_paid", F.floor("price_paid"))
    return cleaning.conform(rows, "title_number STRING, price_paid BIGINT, tenure INT")
