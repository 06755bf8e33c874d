"""Labels, rankings, shares, joins and reports on the ownership ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedscope.operators import joins, labelling, reports
from deedscope.workload.registry import query
from deedscope.workload.tables import (
    AVERAGE_PRICE_LIMIT, HIGH_PRICE, price_index, read, registry, rounded, rounded_sql, with_views,
)

COUNTY, LEFT_OUT, DISTRICT = "EUROPE", "NATION_3", "NATION_8"

_OWNER_RULE = f"""CASE WHEN price_paid > {HIGH_PRICE} OR proprietor1 IS NULL
  OR country <> 'UK' THEN 1 ELSE 0 END"""
_GAP_RULE = f"""CASE WHEN price_paid > {HIGH_PRICE} THEN 1
  WHEN proprietor1 IS NULL OR proprietor2 IS NULL OR address1 IS NULL THEN 1
  WHEN country <> 'UK' THEN 1 ELSE 0 END"""
# The columns whose NULL makes a row unscorable.
_REQUIRED = ["tenure", "district", "region", "country", "price_paid"]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _REQUIRED)


def owner_labelled(spark, sf) -> DataFrame:
    return labelling.label_by_owner(registry(spark, sf), high_price=HIGH_PRICE)


def flagged(spark, sf) -> DataFrame:
    return owner_labelled(spark, sf).filter(F.col("is_fraud") == 1)


_FLAGGED = f"flagged AS (SELECT * FROM registry WHERE {_OWNER_RULE} = 1)"


# --- labels --------------------------------------------------------------------------------------


@query("label_rule_a", with_views(f"SELECT title_number, {_OWNER_RULE} AS is_fraud FROM registry", "registry"))
def label_rule_a(spark, sf):
    return owner_labelled(spark, sf).select("title_number", "is_fraud")


@query(
    "label_rule_b",
    with_views(
        f"""SELECT title_number,
          CASE WHEN proprietor1 IS NULL OR proprietor2 IS NULL THEN 1 ELSE 0 END AS missing_proprietor_name,
          {_GAP_RULE} AS is_fraud FROM registry""",
        "registry",
    ),
)
def label_rule_b(spark, sf):
    return labelling.label_by_gaps(registry(spark, sf), high_price=HIGH_PRICE).select(
        "title_number", "missing_proprietor_name", "is_fraud"
    )


@query(
    "label_rule_c",
    with_views(
        f"""SELECT region_name, date_taken,
          CASE WHEN detached_price < {AVERAGE_PRICE_LIMIT} THEN 0 ELSE 1 END AS is_fraud,
          CASE WHEN detached_price < {AVERAGE_PRICE_LIMIT} THEN 1 ELSE 0 END AS is_non_fraud
        FROM price_index""",
        "price_index",
    ),
)
def label_rule_c(spark, sf):
    options = {"limit": AVERAGE_PRICE_LIMIT, "price_column": "detached_price"}
    once = labelling.label_by_average(price_index(spark, sf), **options)
    both = labelling.label_by_average(once, label="is_non_fraud", mirrored=True, **options)
    return both.select("region_name", "date_taken", "is_fraud", "is_non_fraud")


@query(
    "labelled_registry",
    with_views(
        f"SELECT title_number, {_GAP_RULE} AS is_fraud, price_paid FROM registry WHERE {_COMPLETE}", "registry"
    ),
)
def labelled_registry(spark, sf):
    labelled, _ = labelling.split_scorable(
        registry(spark, sf), required=_REQUIRED, high_price=HIGH_PRICE
    )
    return labelled.select("title_number", "is_fraud", "price_paid")


@query(
    "unscorable_anti",
    with_views(
        f"""SELECT h.title_number, h.district, h.price_paid FROM registry h WHERE NOT EXISTS
          (SELECT 1 FROM (SELECT title_number FROM registry WHERE {_COMPLETE}) f
           WHERE f.title_number = h.title_number)""",
        "registry",
    ),
)
def unscorable_anti(spark, sf):
    _, rest = labelling.split_scorable(
        registry(spark, sf), required=_REQUIRED, high_price=HIGH_PRICE
    )
    return rest.select("title_number", "district", "price_paid")


@query(
    "class_share",
    with_views(
        f"""SELECT sum({_OWNER_RULE})::BIGINT AS flagged_rows, count(*) AS num_rows,
          round(sum({_OWNER_RULE}) / count(*) * 100, 4) AS flagged_percentage FROM registry""",
        "registry",
    ),
)
def class_share(spark, sf):
    return reports.class_share(owner_labelled(spark, sf))


# --- rankings and totals ---------------------------------------------------------------------------


@query(
    "flagged_by_country",
    with_views(f"WITH {_FLAGGED} SELECT country, count(*) AS num_rows FROM flagged GROUP BY country", "registry"),
)
def flagged_by_country(spark, sf):
    return reports.count_by(flagged(spark, sf), "country")


def _ranking_sql(key: str) -> str:
    return with_views(
        f"""SELECT {key}, count({key}) AS number_incorporated, round(sum(price_paid) / 1e6, 1) AS total_price
        FROM registry GROUP BY {key} ORDER BY total_price DESC NULLS LAST, {key} NULLS LAST LIMIT 15""",
        "registry",
    )


@query("jurisdiction_top15", _ranking_sql("country"))
def jurisdiction_top15(spark, sf):
    return reports.jurisdiction_ranking(registry(spark, sf), divisor=1e6)


@query("postcode_top15", _ranking_sql("postcode"))
def postcode_top15(spark, sf):
    return reports.jurisdiction_ranking(registry(spark, sf), key="postcode", divisor=1e6)


@query(
    "region_totals",
    with_views(
        """SELECT region, count(region) AS number_owned, round(sum(price_paid) / 1e6, 1) AS total_price_millions
        FROM registry WHERE region IS NOT NULL GROUP BY region""",
        "registry",
    ),
)
def region_totals(spark, sf):
    return reports.region_totals(registry(spark, sf))


_DISTRICT_SQL = f"""SELECT district, count(district) AS number_owned,
  round(sum(price_paid) / 1e6, 1) AS total_price, round(sum(price_paid) / count(district), 2) AS average_price
FROM registry WHERE upper(county) = '{COUNTY}' AND district <> '{LEFT_OUT}' GROUP BY district"""


@query("district_totals", with_views(_DISTRICT_SQL + " ORDER BY total_price DESC, district LIMIT 15", "registry"))
def district_totals(spark, sf):
    return reports.district_totals(registry(spark, sf), county=COUNTY, excluded_district=LEFT_OUT, divisor=1e6)


@query(
    "district_report",
    with_views(
        f"""SELECT district, format('{{:,}}', number_owned) AS number_owned,
          format('{{:,.2f}}', total_price) AS total_price, format('{{:,.2f}}', average_price) AS average_price
        FROM ({_DISTRICT_SQL})""",
        "registry",
    ),
)
def district_report(spark, sf):
    totals = reports.district_totals(
        registry(spark, sf), county=COUNTY, excluded_district=LEFT_OUT, divisor=1e6, top=None
    )
    return reports.formatted_districts(totals)


@query(
    "address_pairs_having",
    with_views(
        """SELECT country, address1, count(*) AS company_count FROM registry
        GROUP BY country, address1 HAVING count(*) > 1""",
        "registry",
    ),
)
def address_pairs_having(spark, sf):
    return reports.repeated_groups(registry(spark, sf), ["country", "address1"])


_STANDARD_SQL = """regexp_replace(regexp_replace(regexp_replace(lower(address1),
  'st[\\. ]?helier', 'St Helier', 'g'), 'esplandade|esplanande|esplande|esplanade', 'Esplanade', 'g'),
  '[\\.,]', '', 'g')"""


@query(
    "address_clusters",
    with_views(
        f"""SELECT country, rpad(address, 53, ' ') AS standardized_address,
          lpad(CAST(n AS VARCHAR), 5, ' ') AS companies_incorporated
        FROM (SELECT country, {_STANDARD_SQL} AS address, count(*) AS n FROM registry
              WHERE country = 'MACHINERY' GROUP BY 1, 2 HAVING count(*) > 20) WHERE address IS NOT NULL
        UNION ALL
        SELECT country, NULL, lpad(CAST(count(*) AS VARCHAR), 5, ' ') FROM registry
        WHERE country = 'MACHINERY' AND address1 IS NULL GROUP BY country HAVING count(*) > 20""",
        "registry",
    ),
)
def address_clusters(spark, sf):
    return reports.address_clusters(registry(spark, sf), jurisdiction="MACHINERY", more_than=20)


@query(
    "sum_ratio",
    with_views(
        f"""SELECT round(sum(price_paid), 2) AS total_price, min(price_paid) AS min_price,
          max(price_paid) AS max_price, round(sum(price_paid) / count(price_paid), 2) AS average_price,
          round(sum(CASE WHEN upper(county) = '{COUNTY}' THEN price_paid END) / sum(price_paid), 6) AS part_of_total
        FROM registry""",
        "registry",
    ),
)
def sum_ratio(spark, sf):
    return reports.price_summary(registry(spark, sf), part=F.upper("county") == COUNTY)


@query(
    "conditional_counts",
    with_views(
        f"""SELECT count(*) FILTER (district = '{DISTRICT}' AND price_paid > 0) AS priced_in_district,
          count(*) FILTER (price_paid IS NULL) AS unpriced FROM registry""",
        "registry",
    ),
)
def conditional_counts(spark, sf):
    return reports.count_conditions(
        registry(spark, sf),
        priced_in_district=(F.col("district") == DISTRICT) & (F.col("price_paid") > 0),
        unpriced=F.col("price_paid").isNull(),
    )


# --- shares, ranks, maxima ----------------------------------------------------------------------------


@query(
    "partition_counts",
    with_views(
        "SELECT DISTINCT district, county, count(district) OVER (PARTITION BY district) AS owned FROM registry",
        "registry",
    ),
)
def partition_counts(spark, sf):
    return reports.district_counts(registry(spark, sf), per_county=False)


@query(
    "partition_max",
    with_views(
        """SELECT DISTINCT district, county, count(district) OVER w AS owned, max(price_paid) OVER w AS highest
        FROM registry WINDOW w AS (PARTITION BY district, county)""",
        "registry",
    ),
)
def partition_max(spark, sf):
    return registry(spark, sf).groupBy("district", "county").agg(
        F.count("district").alias("owned"), F.max("price_paid").alias("highest")
    )


@query(
    "share_of_total",
    with_views(
        """SELECT district, county, owned, round(owned / sum(owned) OVER () * 100, 2) AS percentage_share
        FROM (SELECT DISTINCT district, county, count(district) OVER (PARTITION BY district, county) AS owned
              FROM registry)""",
        "registry",
    ),
)
def share_of_total(spark, sf):
    return reports.with_share_of_total(reports.district_counts(registry(spark, sf)), "owned")


@query(
    "dense_rank_top10",
    with_views(
        """SELECT * FROM (SELECT postcode, owned, dense_rank() OVER (ORDER BY owned DESC) AS rank
          FROM (SELECT postcode, count(*) AS owned FROM registry GROUP BY postcode)) WHERE rank <= 10""",
        "registry",
    ),
)
def dense_rank_top10(spark, sf):
    counted = registry(spark, sf).groupBy("postcode").agg(F.count("*").alias("owned"))
    return reports.top_ranked(counted, "owned").select("postcode", "owned", F.col("rank").cast("bigint").alias("rank"))


@query(
    "most_expensive",
    with_views(
        """WITH per_district AS (SELECT DISTINCT district, county, count(district) OVER w AS owned,
            max(price_paid) OVER w AS highest FROM registry WINDOW w AS (PARTITION BY district, county)),
          top AS (SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY owned DESC) AS rank FROM per_district)
                  WHERE rank <= 10)
        SELECT t.district, t.county, t.rank, '£' || format('{:,.2f}', t.highest) AS property_value,
          h.proprietor1 AS company_name, h.country, h.tenure, substr(h.address1, 1, 40) AS address,
          h.multiple_address
        FROM top t JOIN registry h ON t.district = h.district AND t.highest = h.price_paid""",
        "registry",
    ),
)
def most_expensive(spark, sf):
    result = reports.most_expensive(registry(spark, sf))
    return result.withColumn("rank", F.col("rank").cast("bigint"))


# --- joins ----------------------------------------------------------------------------------------------


@query(
    "raw_vs_label",
    with_views(
        f"""SELECT b.is_fraud, a.title_number, a.country, a.price_paid, a.postcode, a.district
        FROM registry a JOIN (SELECT title_number, {_OWNER_RULE} AS is_fraud FROM registry
          WHERE {_COMPLETE}) b ON a.title_number = b.title_number""",
        "registry",
    ),
)
def raw_vs_label(spark, sf):
    raw = registry(spark, sf)
    labelled = labelling.label_by_owner(raw.dropna(subset=_REQUIRED), high_price=HIGH_PRICE)
    return joins.labels_beside_source(
        raw, labelled, "title_number", ["country", "price_paid", "postcode", "district"]
    )


@query(
    "all_columns_join",
    with_views(
        f"""WITH groups AS (SELECT DISTINCT tenure, district, county, country, category FROM registry),
          prices AS (SELECT tenure, district, county, country, category, {rounded_sql("avg(price_paid)")} AS mean_price
                     FROM registry GROUP BY ALL)
        SELECT tenure, district, county, country, category, mean_price FROM prices
        JOIN groups USING (tenure, district, county, country, category)""",
        "registry",
    ),
)
def all_columns_join(spark, sf):
    keys = ["tenure", "district", "county", "country", "category"]
    rows = registry(spark, sf)
    prices = rows.groupBy(*keys).agg(rounded(F.avg("price_paid")).alias("mean_price"))
    return joins.join_on_shared_text(prices, rows.select(*keys).distinct(), ["mean_price"])


@query(
    "distinct_left_join",
    with_views(
        f"""WITH owned AS (SELECT district, county, count(*) AS titles FROM registry
            WHERE upper(county) = '{COUNTY}' AND district IS NOT NULL GROUP BY district, county),
          months AS (SELECT region_name, date_taken, {rounded_sql("average_price")} AS price FROM price_index
            GROUP BY region_name, date_taken, average_price)
        SELECT lower(o.district) AS region_name, m.region_name AS gd_region_name, m.date_taken AS gd_date_taken,
          m.price AS gd_average_price, o.district AS bd_district, o.county AS bd_county, o.titles AS bd_owned
        FROM owned o JOIN months m ON lower(m.region_name) = lower(o.district)""",
        "registry", "price_index",
    ),
)
def distinct_left_join(spark, sf):
    good = price_index(spark, sf).select(
        "region_name", "date_taken", rounded("average_price").alias("average_price")
    )
    bad = (
        registry(spark, sf)
        .filter(F.upper("county") == COUNTY)
        .groupBy("district", "county")
        .agg(F.count("*").alias("owned"))
    )
    return joins.distinct_pairs(good, bad, "region_name", "district")


@query(
    "width_cross_join",
    with_views(
        """WITH w AS (SELECT max(length(title_number)) AS a, max(length(address1)) AS b FROM registry)
        SELECT rpad(title_number, a::INT, ' ') AS title_number, rpad(address1, b::INT, ' ') AS address1,
          repeat('-', a::INT) || '-+-' || repeat('-', b::INT) AS rule FROM registry CROSS JOIN w""",
        "registry",
    ),
)
def width_cross_join(spark, sf):
    return joins.with_width_columns(registry(spark, sf), ["title_number", "address1"])


# Districts that have flagged titles and an index under the same name, letter case aside: each
# side's mean by itself, both rounded, and how often the one holds the other.
_RATIO_SQL = """SELECT o.county, o.district, round(o.mean_price) AS average_owned, round(i.mean_price) AS average_index,
  floor(round(round(o.mean_price) / round(i.mean_price)))::BIGINT AS price_ratio
FROM (SELECT county, district, avg(price_paid) AS mean_price FROM flagged GROUP BY county, district) o,
  (SELECT region_name, avg(average_price) AS mean_price FROM price_index GROUP BY region_name) i
WHERE lower(o.district) = lower(i.region_name) AND o.district <> 'NULL'"""


def _with_flagged(body: str) -> str:
    return with_views(f"WITH {_FLAGGED} {body}", "registry", "price_index")


@query("price_ratio", _with_flagged(_RATIO_SQL))
def price_ratio(spark, sf):
    return reports.price_comparison(flagged(spark, sf), price_index(spark, sf))


@query(
    "price_comparison",
    _with_flagged(
        f"""SELECT *, round(number_owned / sum(number_owned) OVER () * 100, 1) AS percentage_share FROM (
        SELECT r.*, o.number_owned FROM ({_RATIO_SQL}) r
        JOIN (SELECT district, count(district) AS number_owned FROM flagged GROUP BY district) o USING (district)
        WHERE r.district <> '{LEFT_OUT}' ORDER BY number_owned DESC, district, county LIMIT 15)"""
    ),
)
def price_comparison(spark, sf):
    return reports.district_comparison(flagged(spark, sf), price_index(spark, sf), excluded_district=LEFT_OUT)


@query(
    "overall_ratio",
    _with_flagged(
        """SELECT round(sum(price_paid), 2) AS total_flagged, round(sum(price_paid) / count(price_paid), 2) AS average_flagged,
        round(sum(price_paid) / (SELECT sum(average_price) FROM price_index), 6) AS ratio_to_index FROM flagged"""
    ),
)
def overall_ratio(spark, sf):
    return reports.overall_ratio(flagged(spark, sf), price_index(spark, sf))


# --- listings and whole reports -----------------------------------------------------------------------------


@query(
    "drilldown",
    with_views(
        """SELECT title_number, substr(address1, 1, 50) AS property_address, postcode AS post_code,
          '£' || format('{:,.2f}', price_paid) AS purchase_price, country AS incorporated, proprietor1
        FROM registry WHERE contains(title_number, '77')""",
        "registry",
    ),
)
def drilldown(spark, sf):
    return reports.drill_down(registry(spark, sf), "77")


def _stack(parts: dict[str, DataFrame], items: dict[str, tuple[str, str]]) -> DataFrame:
    """A report's tables as (section, item, amount) rows."""
    rows = [
        parts[section].select(
            F.lit(section).alias("section"),
            F.col(item).cast("string").alias("item"),
            F.col(amount).cast("double").alias("amount"),
        )
        for section, (item, amount) in items.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def histogram_sql(source: str, value: str, bins: int) -> str:
    """Equal-width bins as (bin, num_rows), empty ones included."""
    return f"""SELECT b.bin, coalesce(c.n, 0) AS num_rows FROM (SELECT unnest(range({bins})) AS bin) b
      LEFT JOIN (SELECT least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, count(*) AS n
        FROM (SELECT {value} AS v, min({value}) OVER () AS lo, max({value}) OVER () AS hi
              FROM ({source}) WHERE {value} IS NOT NULL) GROUP BY 1) c ON b.bin = c.bin"""


_BAND_SQL = f"""SELECT price_paid FROM registry WHERE county = '{COUNTY}' AND district = '{DISTRICT}'
  AND price_paid BETWEEN 100000 AND 450000"""


@query(
    "overseas_report",
    with_views(
        f"""SELECT 'jurisdictions' AS section, country AS item, count(*)::DOUBLE AS amount FROM registry GROUP BY country
        UNION ALL SELECT 'district_shares', district, round(owned / sum(owned) OVER () * 100, 2) FROM
          (SELECT DISTINCT district, county, count(district) OVER (PARTITION BY district) AS owned FROM registry)
        UNION ALL SELECT 'county_ranking', district, count(district) FROM registry WHERE county = '{COUNTY}' GROUP BY district
        UNION ALL SELECT 'price_distribution', bin::VARCHAR, num_rows
          FROM ({histogram_sql(_BAND_SQL, 'price_paid', 30)})""",
        "registry",
    ),
)
def overseas_report(spark, sf):
    parts = reports.overseas_ownership(
        registry(spark, sf), county=COUNTY, district=DISTRICT, low=100_000, high=450_000
    )
    return _stack(
        parts,
        {
            "jurisdictions": ("country", "num_rows"),
            "district_shares": ("district", "percentage_share"),
            "county_ranking": ("district", "owned"),
            "price_distribution": ("bin", "num_rows"),
        },
    )


@query(
    "offshore_report",
    _with_flagged(
        f"""SELECT 'regions' AS section, region AS item, round(sum(price_paid) / 1e6, 1) AS amount
          FROM flagged WHERE region IS NOT NULL GROUP BY region
        UNION ALL SELECT * FROM (SELECT 'jurisdictions', country, round(sum(price_paid) / 1e6, 1) AS total FROM flagged GROUP BY country
          ORDER BY total DESC NULLS LAST, country NULLS LAST LIMIT 15)
        UNION ALL SELECT 'districts', district, average_price FROM (
          {_DISTRICT_SQL.replace('FROM registry', 'FROM flagged')} ORDER BY total_price DESC, district LIMIT 15)
        UNION ALL SELECT 'comparison', district, price_ratio FROM (SELECT r.*, n FROM ({_RATIO_SQL}) r
          JOIN (SELECT district, count(*) AS n FROM flagged GROUP BY district) o USING (district)
          WHERE upper(county) = '{COUNTY}' AND district <> '{LEFT_OUT}' ORDER BY n DESC, district, county LIMIT 15)
        UNION ALL SELECT 'price_distribution', bin::VARCHAR, num_rows
          FROM ({histogram_sql('SELECT price_paid FROM flagged', 'price_paid', 20)})"""
    ),
)
def offshore_report(spark, sf):
    parts = reports.offshore_comparison(
        flagged(spark, sf), price_index(spark, sf), county=COUNTY, excluded_district=LEFT_OUT, divisor=1e6
    )
    return _stack(
        parts,
        {
            "regions": ("region", "total_price_millions"),
            "jurisdictions": ("country", "total_price"),
            "districts": ("district", "average_price"),
            "comparison": ("district", "price_ratio"),
            "price_distribution": ("bin", "num_rows"),
        },
    )


@query(
    "segment_counts",
    "SELECT c_mktsegment, count(*) AS num_rows FROM customer GROUP BY c_mktsegment",
)
def segment_counts(spark, sf):
    return reports.count_by(read(spark, sf, "customer"), "c_mktsegment")
