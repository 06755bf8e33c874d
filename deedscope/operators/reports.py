"""Ownership and price reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedscope.functions.scalars import holds_keyword, percent_of, pounds
from deedscope.operators.cleaning import in_price_band, standard_address
from deedscope.operators.profiling import histogram
from deedscope.plans.lineage import cut_lineage

# --- rankings and totals -----------------------------------------------------------------------


def count_by(df: DataFrame, *keys: str, name: str = "num_rows") -> DataFrame:
    """Rows per group, most frequent first."""
    counted = df.groupBy(*keys).agg(F.count("*").alias(name))
    return counted.orderBy(F.desc(name), *keys)


def jurisdiction_ranking(
    df: DataFrame, *, key: str = "country", price: str = "price_paid", top: int | None = 15,
    divisor: float = 1e9, decimals: int = 1,
) -> DataFrame:
    """Owners per jurisdiction and their total price, by total; an unknown jurisdiction counts 0."""
    totals = df.groupBy(key).agg(
        F.count(key).alias("number_incorporated"),
        F.round(F.sum(price) / divisor, decimals).alias("total_price"),
    )
    ranked = totals.orderBy(F.desc_nulls_last("total_price"), F.asc_nulls_last(key))
    return ranked.limit(top) if top else ranked


def region_totals(df: DataFrame, *, divisor: float = 1e6) -> DataFrame:
    return (
        df.filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(
            F.count("region").alias("number_owned"),
            F.round(F.sum("price_paid") / divisor, 1).alias("total_price_millions"),
        )
        .orderBy(F.desc("number_owned"), "region")
    )


def district_totals(
    df: DataFrame, *, county: str, excluded_district: str, top: int | None = 15,
    divisor: float = 1e9, decimals: int = 1,
) -> DataFrame:
    """Count, total and average price per district of a county.

    The average divides by all rows, as the report does, though unknown prices add nothing.
    """
    ranked = (
        df.filter((F.upper("county") == county) & (F.col("district") != excluded_district))
        .groupBy("district")
        .agg(
            F.count("district").alias("number_owned"),
            F.round(F.sum("price_paid") / divisor, decimals).alias("total_price"),
            F.round(F.sum("price_paid") / F.count("district"), 2).alias("average_price"),
        )
        .orderBy(F.desc_nulls_last("total_price"), "district")
    )
    return ranked.limit(top) if top else ranked


def repeated_groups(df: DataFrame, keys: Sequence[str], more_than: int = 1) -> DataFrame:
    """Key combinations held by more than ``more_than`` rows."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("company_count"))
    return counted.filter(F.col("company_count") > more_than).orderBy(
        F.desc("company_count"), *[F.asc_nulls_last(k) for k in keys]
    )


def address_clusters(
    df: DataFrame, *, jurisdiction: str, address: str = "address1", more_than: int = 100,
    widths: tuple[int, int] = (53, 5),
) -> DataFrame:
    """Addresses shared by many owners of a jurisdiction, after standardising, as padded text."""
    clusters = (
        df.filter(F.col("country") == jurisdiction)
        .groupBy("country", standard_address(address).alias("address"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > more_than)
    )
    return clusters.orderBy(F.desc("n"), "address").select(
        "country",
        F.rpad("address", widths[0], " ").alias("standardized_address"),
        F.lpad(F.col("n").cast("string"), widths[1], " ").alias("companies_incorporated"),
    )


def class_share(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Flagged rows, all rows, and the percentage."""
    flagged = F.count_if(F.col(label) == 1)
    return df.agg(
        flagged.alias("flagged_rows"),
        F.count("*").alias("num_rows"),
        percent_of(flagged, F.count("*"), 4).alias("flagged_percentage"),
    )


def price_summary(df: DataFrame, price: str = "price_paid", part: Column | None = None) -> DataFrame:
    """Sum, extremes, average, and the share of the sum that falls to ``part``, in one pass."""
    amount = F.col(price)
    within = amount if part is None else F.when(part, amount)
    return df.agg(
        F.round(F.sum(amount), 2).alias("total_price"),
        F.min(amount).alias("min_price"),
        F.max(amount).alias("max_price"),
        F.round(F.sum(amount) / F.count(amount), 2).alias("average_price"),
        F.round(F.sum(within) / F.sum(amount), 6).alias("part_of_total"),
    )


def count_conditions(df: DataFrame, **conditions: Column) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


# --- shares, ranks, per-district maxima ----------------------------------------------------------


def district_counts(df: DataFrame, *, per_county: bool = True) -> DataFrame:
    """Owned properties per district and county, without a window over all rows.

    With ``per_county`` false every county of a district shows the whole district's count, as
    the first report has it. The unknown district counts 0.
    """
    by_pair = df.groupBy("district", "county").agg(F.count("district").alias("owned"))
    if per_county:
        return by_pair
    # The window runs over one row per pair, not over the ledger.
    return by_pair.select(
        "district", "county", F.sum("owned").over(Window.partitionBy("district")).alias("owned")
    )


def with_share_of_total(df: DataFrame, amount: str, *, decimals: int = 2) -> DataFrame:
    """Add each row's percentage of the column's total; the total is one scalar."""
    total = df.agg(F.sum(amount).alias("t")).scalar()
    return df.withColumn("percentage_share", percent_of(F.col(amount), total, decimals))


def top_ranked(df: DataFrame, amount: str, *, ranks: int = 10, name: str = "rank") -> DataFrame:
    """Rows whose ``amount`` is among the ``ranks`` highest distinct amounts, with dense rank.

    Only those few amounts are numbered; the rows, ties included, meet them in a join, so no
    task has to hold all rows.
    """
    highest = (
        df.filter(F.col(amount).isNotNull())
        .groupBy(amount).agg(F.lit(1).alias("__one"))
        .orderBy(F.desc(amount)).limit(ranks)
        .select(amount, F.dense_rank().over(Window.orderBy(F.desc(amount))).alias(name))
    )
    # ``highest`` has at most ``ranks`` rows by construction.
    return df.join(F.broadcast(highest), amount)


def most_expensive(df: DataFrame, *, ranks: int = 10) -> DataFrame:
    """The dearest properties of the districts with the most owned properties, ties included.

    The maximum belongs to a district and county; it is matched back on the district alone.
    """
    # Kept, for it is ranked and then joined: the ledger is read once for it and once for the rows.
    per_district = cut_lineage(
        df.groupBy("district", "county").agg(F.count("district").alias("owned"), F.max("price_paid").alias("highest"))
    )
    # Rank, then match: the ranked side has few rows, yet ties make its size unknown, so the
    # join is left to the optimiser's own size estimate.
    top = top_ranked(per_district, "owned", ranks=ranks).alias("t")
    rows = df.alias("h")
    return top.join(
        rows, (F.col("t.district") == F.col("h.district")) & (F.col("t.highest") == F.col("h.price_paid"))
    ).select(
        F.col("t.district").alias("district"),
        F.col("t.county").alias("county"),
        F.col("t.rank").alias("rank"),
        pounds("t.highest").alias("property_value"),
        F.col("h.proprietor1").alias("company_name"),
        F.col("h.country").alias("country"),
        F.col("h.tenure").alias("tenure"),
        F.col("h.address1").substr(1, 40).alias("address"),
        F.col("h.multiple_address").alias("multiple_address"),
    )


# --- comparisons ---------------------------------------------------------------------------------


def price_comparison(
    flagged: DataFrame, index: DataFrame, *, county: str | None = None, price: str = "price_paid",
    index_price: str = "average_price",
) -> DataFrame:
    """Average flagged price against the index average per district, and their ratio.

    The report averages over a many-to-many join of ledger and index rows. Within one pair of
    names every row is repeated equally often, so averages taken before the join are the same,
    and one row per district meets one row per region.
    """
    ledger = flagged.filter(F.col("district").isNotNull())
    if county is not None:
        ledger = ledger.filter(F.upper("county") == county)
    offshore = ledger.groupBy("county", "district").agg(F.round(F.avg(price), 0).alias("average_owned"))
    ordinary = index.groupBy("region_name").agg(F.round(F.avg(index_price), 0).alias("average_index"))
    return offshore.join(ordinary, F.lower("district") == F.lower("region_name")).select(
        "county", "district", "average_owned", "average_index",
        F.floor(F.round(F.col("average_owned") / F.col("average_index"), 0)).alias("price_ratio"),
    )


def district_comparison(
    flagged: DataFrame, index: DataFrame, *, excluded_district: str, top: int = 15, **options
) -> DataFrame:
    """The comparison beside the number owned, for the districts with the most, and their shares."""
    owned = flagged.groupBy("district").agg(F.count("district").alias("number_owned"))
    best = (
        price_comparison(flagged, index, **options)
        .join(owned, "district")
        .filter(F.col("district") != excluded_district)
        .orderBy(F.desc("number_owned"), "district", "county")
        .limit(top)
    )
    return with_share_of_total(best, "number_owned", decimals=1)


def overall_ratio(flagged: DataFrame, index: DataFrame, *, price: str = "price_paid") -> DataFrame:
    """Total flagged price against the total of the index averages, one row."""
    a = flagged.agg(F.sum(price).alias("s"), F.count(price).alias("n"))
    index_total = index.agg(F.sum("average_price").alias("s")).scalar()
    return a.select(
        F.round("s", 2).alias("total_flagged"),
        F.round(F.col("s") / F.col("n"), 2).alias("average_flagged"),
        F.round(F.col("s") / index_total, 6).alias("ratio_to_index"),
    )


# --- listings --------------------------------------------------------------------------------------


def drill_down(df: DataFrame, title_part: str) -> DataFrame:
    """The rows of a title, formatted for reading, cheapest first."""
    found = df.filter(F.contains(F.col("title_number"), F.lit(title_part)))
    return found.orderBy("price_paid", "title_number").select(
        "title_number",
        F.col("address1").substr(1, 50).alias("property_address"),
        F.col("postcode").alias("post_code"),
        pounds("price_paid").alias("purchase_price"),
        F.col("country").alias("incorporated"),
        "proprietor1",
    )


def formatted_districts(totals: DataFrame) -> DataFrame:
    """District totals with grouped digits, in district order."""
    return totals.orderBy("district").select(
        "district",
        F.format_number("number_owned", 0).alias("number_owned"),
        F.format_number("total_price", 2).alias("total_price"),
        F.format_number("average_price", 2).alias("average_price"),
    )


def keyword_search(df: DataFrame, column: str, keyword: str) -> DataFrame:
    return df.filter(holds_keyword(column, keyword))


# --- whole reports -----------------------------------------------------------------------------------


def overseas_ownership(
    df: DataFrame, *, county: str, district: str, low: float = 1e6, high: float = 1e8, bins: int = 30
) -> dict[str, DataFrame]:
    """The tables of the overseas-ownership report."""
    in_county = district_counts(df.filter(F.col("county") == county), per_county=False)
    return {
        "jurisdictions": count_by(df, "country"),
        "district_shares": with_share_of_total(district_counts(df, per_county=False), "owned"),
        "county_ranking": in_county.select("district", "owned").orderBy(F.desc("owned"), "district"),
        "price_distribution": histogram(
            in_price_band(df, county, district, low, high), "price_paid", bins
        ),
    }


def offshore_comparison(
    flagged: DataFrame, index: DataFrame, *, county: str, excluded_district: str, bins: int = 20,
    divisor: float = 1e9, decimals: int = 1,
) -> dict[str, DataFrame]:
    """The tables of the flagged-against-ordinary report.

    They need few columns of the flagged rows, which are kept, so the ledger is read once.
    """
    flagged = cut_lineage(flagged.select("region", "country", "district", "county", "price_paid"))
    return {
        "regions": region_totals(flagged),
        "jurisdictions": jurisdiction_ranking(flagged, divisor=divisor, decimals=decimals),
        "districts": district_totals(
            flagged, county=county, excluded_district=excluded_district, divisor=divisor,
            decimals=decimals,
        ),
        "comparison": district_comparison(
            flagged, index, county=county, excluded_district=excluded_district
        ),
        "overall": overall_ratio(flagged, index),
        "price_distribution": histogram(flagged, "price_paid", bins),
    }


def parse_size_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Megabytes, release and major release of lines such as ``9.9M ./2.4.0``.

    A part that does not have this form is NULL. The words are cut out in a step of their own:
    written as one expression they would be cut again wherever they are used.
    """
    text = F.trim(F.translate(F.col(column), "\t", " "))
    words = lines.select(text.alias("__line")).select(
        F.substring_index("__line", " ", 1).alias("__size"),
        F.substring_index("__line", " ./", -1).alias("__release"),
        F.contains("__line", F.lit(" ./")).alias("__has_release"),
    )
    number = F.substr("__size", F.lit(1), F.length("__size") - 1)
    factor = F.when(F.endswith("__size", F.lit("G")), 1024.0).when(F.endswith("__size", F.lit("M")), 1.0)
    is_size = F.col("__size").rlike(r"^\d+(\.\d*)?[MG]$")
    major = F.substring_index("__release", ".", 1)
    is_major = F.col("__has_release") & F.col("__release").rlike(r"^\d+\.")
    return words.select(
        F.when(is_size, number.try_cast("double") * factor).alias("megabytes"),
        F.when(F.col("__has_release"), F.col("__release")).alias("release"),
        F.when(is_major, major).alias("major_release"),
    )


def size_totals(lines: DataFrame, column: str = "value") -> DataFrame:
    """Megabytes per major release, and the grand total, of size lines."""
    # Lines without a release add nothing to their group, which is dropped by its empty sum. A
    # filter on the release itself would be pushed to the scan and parse every line twice.
    known = F.when(F.col("major_release").isNotNull(), F.col("megabytes"))
    totals = (
        parse_size_lines(lines, column)
        .groupBy("major_release")
        .agg(F.sum(known).alias("megabytes"))
        .filter(F.col("megabytes").isNotNull())
    )
    return (
        totals.rollup("major_release")
        .agg(F.round(F.sum("megabytes"), 2).alias("total_megabytes"))
        .select(F.coalesce("major_release", F.lit("Total")).alias("major_release"), "total_megabytes")
    )
