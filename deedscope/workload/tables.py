"""The given tables, and the ledger and index views derived from them.

``registry`` plays the ownership ledger: orders are titles, nations are districts, regions
are counties. NULLs and rogue values are injected by key arithmetic, because the given tables
hold none. ``price_index`` is the monthly index per district, one column per property type.
Each view is written twice: as DataFrame code and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The layout of the given tables. Declared, because inferring it costs one job per
# table before a query starts.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = list(SCHEMAS)

# Label threshold of the mapped ledger and the index, in the scale of o_totalprice.
HIGH_PRICE = 300_000
AVERAGE_PRICE_LIMIT = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def rounded(value: Column | str, digits: int = 2) -> Column:
    """Rounded for comparison: engines treat an exact half differently, so it is nudged up."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-6, digits)


def rounded_sql(value: str, digits: int = 2) -> str:
    return f"round({value} + 1e-6, {digits})"


def _null_every(n: int, key: str, value):
    return F.when(F.col(key) % n != 0, value)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    places = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("o_orderkey")
    variant = (
        F.when(key % 5 == 0, "St Helier, Esplanade")
        .when(key % 5 == 1, "St.Helier Esplandade.")
        .when(key % 5 == 2, "STHELIER, Esplanande")
        .when(key % 5 == 3, "St. Helier, Esplande")
        .otherwise("St Peter Port (Harbour)!")
    )
    tenure = (
        F.when(key % 97 == 0, "93347")
        .when(key % 89 == 0, F.lit(None))
        .when(F.col("o_orderstatus") == "F", "Leasehold")
        .when(F.col("o_orderstatus") == "O", "Freehold")
        .otherwise("Commonhold")
    )
    country = F.when(F.col("c_mktsegment") == "BUILDING", "UK").otherwise(F.col("c_mktsegment"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("T"), F.lpad(key.cast("string"), 12, "0")).alias("title_number"),
            tenure.alias("tenure"),
            _null_every(101, "o_orderkey", F.col("n_name")).alias("district"),
            F.col("r_name").alias("county"),
            _null_every(103, "o_orderkey", F.col("r_name")).alias("region"),
            F.concat(F.lit("ZZ"), F.col("n_nationkey"), F.lit(" "), key % 10).alias("postcode"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Y").otherwise("N").alias("multiple_address"),
            _null_every(11, "o_orderkey", F.col("o_totalprice")).alias("price_paid"),
            _null_every(13, "o_custkey", F.col("c_name")).alias("proprietor1"),
            _null_every(3, "o_orderkey", F.concat(F.lit("Holder "), F.col("o_custkey") % 1000)).alias(
                "proprietor2"
            ),
            F.col("o_orderpriority").alias("category"),
            _null_every(107, "o_orderkey", country).alias("country"),
            _null_every(59, "o_orderkey", F.concat(variant, F.lit(" "), F.col("n_nationkey"))).alias(
                "address1"
            ),
            F.col("o_orderdate").cast("date").alias("date_added"),
        )
    )


# Column suffix of each property type and the order priority that plays it.
PROPERTY_TYPES = {
    "detached": "1-URGENT",
    "semi_detached": "2-HIGH",
    "terraced": "3-MEDIUM",
    "flat": "4-NOT SPECIFIED",
    "new_build": "5-LOW",
}


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    nation = read(spark, sf_dir, "nation")
    price = F.col("o_totalprice")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.col("n_name").alias("region_name"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date_taken"),
        )
        .agg(
            F.avg(price).alias("average_price"),
            *[
                F.avg(F.when(F.col("o_orderpriority") == code, price)).alias(f"{kind}_price")
                for kind, code in PROPERTY_TYPES.items()
            ],
            F.count("*").alias("sales_volume"),
        )
    )


_CTES = {
    "registry": """registry AS (
  SELECT 'T' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS title_number,
    CASE WHEN o_orderkey % 97 = 0 THEN '93347' WHEN o_orderkey % 89 = 0 THEN NULL
         WHEN o_orderstatus = 'F' THEN 'Leasehold' WHEN o_orderstatus = 'O' THEN 'Freehold'
         ELSE 'Commonhold' END AS tenure,
    CASE WHEN o_orderkey % 101 <> 0 THEN n_name END AS district,
    r_name AS county,
    CASE WHEN o_orderkey % 103 <> 0 THEN r_name END AS region,
    'ZZ' || n_nationkey || ' ' || (o_orderkey % 10) AS postcode,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Y' ELSE 'N' END AS multiple_address,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price_paid,
    CASE WHEN o_custkey % 13 <> 0 THEN c_name END AS proprietor1,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Holder ' || (o_custkey % 1000) END AS proprietor2,
    o_orderpriority AS category,
    CASE WHEN o_orderkey % 107 <> 0
         THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'UK' ELSE c_mktsegment END END AS country,
    CASE WHEN o_orderkey % 59 <> 0 THEN
      CASE o_orderkey % 5 WHEN 0 THEN 'St Helier, Esplanade' WHEN 1 THEN 'St.Helier Esplandade.'
        WHEN 2 THEN 'STHELIER, Esplanande' WHEN 3 THEN 'St. Helier, Esplande'
        ELSE 'St Peter Port (Harbour)!' END || ' ' || n_nationkey END AS address1,
    CAST(o_orderdate AS DATE) AS date_added
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "price_index": """price_index AS (
  SELECT n_name AS region_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS date_taken,
    avg(o_totalprice) AS average_price,
    """
    + "".join(
        f"avg(CASE WHEN o_orderpriority = '{code}' THEN o_totalprice END) AS {kind}_price,\n    "
        for kind, code in PROPERTY_TYPES.items()
    )
    + """count(*) AS sales_volume
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)""",
}


def with_views(body: str, *views: str) -> str:
    """Prefix a SQL body with the views it reads; a body may go on with its own CTEs."""
    ctes = ",\n".join(_CTES[v] for v in views)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
