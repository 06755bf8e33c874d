"""Encoding, scaling, classification, imputation and sampling."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from deedscope.functions.scalars import hashed_unit
from deedscope.operators import cleaning, features, impute, models, profiling, reports, sampling
from deedscope.operators.gram import complete_rows, quantile_grid, rank_correlations
from deedscope.plans.lineage import cut_lineage
from deedscope.workload.ledger import _OWNER_RULE, owner_labelled
from deedscope.workload.profiles import MEASURES, NUMBERS
from deedscope.workload.registry import query
from deedscope.workload.tables import price_index, read, registry, with_views


def _unit_sql(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _positions_sql(column: str, order: str) -> str:
    return f"SELECT {column} AS label, row_number() OVER (ORDER BY {order}) - 1 AS position FROM registry WHERE {column} IS NOT NULL GROUP BY {column}"


@query(
    "string_index",
    with_views(
        f"""SELECT title_number, country, p.position::DOUBLE AS country_index, q.position::DOUBLE AS proprietor1_index
        FROM registry JOIN ({_positions_sql('country', 'count(*) DESC, country')}) p ON country = p.label
        JOIN ({_positions_sql('proprietor1', 'count(*) DESC, proprietor1')}) q ON proprietor1 = q.label""",
        "registry",
    ),
)
def string_index(spark, sf):
    rows = registry(spark, sf).select("title_number", "country", "proprietor1")
    indexed = rows
    for column in ("country", "proprietor1"):
        indexed = features.string_index(indexed, column, positions=features.label_positions(rows, column))
    return indexed.drop("proprietor1")


@query(
    "string_index_keep",
    with_views(
        f"""SELECT title_number, coalesce(p.position, (SELECT count(DISTINCT country) FROM registry))::DOUBLE AS country_index
        FROM registry LEFT JOIN ({_positions_sql('country', 'count(*) DESC, country')}) p ON country = p.label""",
        "registry",
    ),
)
def string_index_keep(spark, sf):
    rows = registry(spark, sf).select("title_number", "country")
    return features.string_index(rows, "country", invalid="keep").drop("country")


def _flags_sql(column: str) -> str:
    """The one-hot places of a column by falling frequency, the last one left out."""
    return f"list_transform(range((SELECT count(DISTINCT {column}) FROM registry) - 1), lambda i: (i = {column}_at.position)::INT)"


@query(
    "feature_vectors",
    with_views(
        f"""SELECT title_number, array_to_string(list_concat({_flags_sql('tenure')}, {_flags_sql('country')}), '') AS flags, price_paid
        FROM registry JOIN ({_positions_sql('tenure', 'count(*) DESC, tenure')}) tenure_at ON tenure = tenure_at.label
        JOIN ({_positions_sql('country', 'count(*) DESC, country')}) country_at ON country = country_at.label
        WHERE price_paid IS NOT NULL""",
        "registry",
    ),
)
def feature_vectors(spark, sf):
    rows = registry(spark, sf).select("title_number", "tenure", "country", "price_paid")
    stages = models.feature_stages(["tenure", "country"], ["price_paid"])
    assembled = Pipeline(stages=stages).fit(rows).transform(rows)
    values = vector_to_array("features")
    flags = F.transform(F.slice(values, 1, F.size(values) - 1), lambda x: x.cast("int").cast("string"))
    return assembled.select(
        "title_number", F.array_join(flags, "").alias("flags"), "price_paid"
    )


@query(
    "feature_vectors_wide",
    with_views(
        f"""WITH owners AS ({_positions_sql('proprietor1', 'count(*) DESC, proprietor1')}), places AS ({_positions_sql('country', 'count(*) DESC, country')}),
        found AS (SELECT title_number, o.position AS owner_at, p.position AS place_at, price_paid, (SELECT count(*) FROM owners) - 1 AS n_owners,
            (SELECT count(*) FROM places) - 1 AS n_places
          FROM registry JOIN owners o ON proprietor1 = o.label JOIN places p ON country = p.label WHERE price_paid IS NOT NULL)
        SELECT title_number, owner_at::INT AS position, 1.0::DOUBLE AS value FROM found WHERE owner_at < n_owners
        UNION ALL SELECT title_number, (n_owners + place_at)::INT, 1.0 FROM found WHERE place_at < n_places
        UNION ALL SELECT title_number, (n_owners + n_places)::INT, price_paid FROM found WHERE price_paid <> 0""",
        "registry",
    ),
)
def feature_vectors_wide(spark, sf):
    """Every customer is a place of the vector: far more than labels on the driver could be."""
    rows = registry(spark, sf).select("title_number", "proprietor1", "country", "price_paid")
    return models.vector_cells(models.wide_features(rows, ["proprietor1", "country"], ["price_paid"]), ["title_number"])


# The categories the given tables hold in these two columns.
_SEGMENTS = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UK"]
_TENURES = ["93347", "Commonhold", "Freehold", "Leasehold"]


def _dummy_sql(column: str, values) -> str:
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS {column}_{v}" for v in values)


@query(
    "dummies",
    with_views(
        f"SELECT title_number, price_paid, {_dummy_sql('country', _SEGMENTS)}, {_dummy_sql('tenure', _TENURES)} FROM registry", "registry"
    ),
)
def dummies(spark, sf):
    rows = registry(spark, sf).select("title_number", "price_paid", "country", "tenure")
    return features.dummies(rows, ["country", "tenure"])


@query(
    "label_encode",
    with_views(
        f"""SELECT title_number, p.position AS proprietor1, {_dummy_sql('country', _SEGMENTS)} FROM registry
        JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS position
              FROM (SELECT DISTINCT coalesce(proprietor1, 'None') AS label FROM registry)) p
          ON coalesce(proprietor1, 'None') = p.label""",
        "registry",
    ),
)
def label_encode(spark, sf):
    rows = registry(spark, sf).select("title_number", "proprietor1", "country")
    return features.encode_table(rows, ["proprietor1", "country"])


def _scaled_sql(c: str) -> str:
    return f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}"


@query(
    "standardise",
    f"SELECT l_orderkey, l_linenumber, {', '.join(map(_scaled_sql, NUMBERS))} FROM lineitem",
)
def standardise(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS)
    scaled = features.standardise(rows, NUMBERS)
    return scaled.withColumns({c: F.round(c, 6) + 0.0 for c in NUMBERS})


@query(
    "standardise_inverse",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem",
)
def standardise_inverse(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    scaling = features.Scaling(rows, ["l_quantity", "l_discount"])
    back = scaling.invert(scaling.apply(rows))
    return back.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_discount")})


@query(
    "auc_rank",
    """SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives,
      round(sum(p * (before + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 9) AS auc FROM (
      SELECT p, n, coalesce(sum(n) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT n_chars, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n
            FROM documents JOIN labels USING (doc_id) GROUP BY n_chars))""",
)
def auc_rank(spark, sf):
    scored = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    result = models.area_under_roc(scored, "quality", "n_chars")
    return result.withColumn("auc", F.round("auc", 9))


_FOREST = {"categorical": ["tenure", "country", "category"], "numeric": ["price_paid"], "label": "is_fraud"}


@query("forest_auc")
def forest_auc(spark, sf):
    return models.forest_auc(owner_labelled(spark, sf), **_FOREST)


@query("forest_scores")
def forest_scores(spark, sf):
    labelled = owner_labelled(spark, sf)
    # Fitted and scored from one kept copy.
    rows = cut_lineage(labelled.select("title_number", "is_fraud", *_FOREST["categorical"], *_FOREST["numeric"]))
    return models.scored_table(models.fit_forest(rows, **_FOREST), rows, ["title_number"], "is_fraud")


@query(
    "forest_rows",
    with_views(
        f"""SELECT count(*) AS num_rows, sum({_OWNER_RULE})::BIGINT AS flagged, true AS probabilities, true AS separates
        FROM registry WHERE tenure IS NOT NULL AND country IS NOT NULL AND category IS NOT NULL AND price_paid IS NOT NULL""",
        "registry",
    ),
)
def forest_rows(spark, sf):
    """What a scored table must be: every complete row, and flagged rows scored above the others."""
    scored = forest_scores(spark, sf)
    mean = lambda label: F.avg(F.when(F.col("is_fraud") == label, F.col("probability")))
    return scored.agg(
        F.count("*").alias("num_rows"), F.sum("is_fraud").alias("flagged"),
        F.every(F.col("probability").between(0, 1)).alias("probabilities"), (mean(1) > mean(0)).alias("separates"),
    )


@query("pca_impute")
def pca_impute(spark, sf):
    rows = read(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    gaps = cleaning.blank_share(rows.select("l_orderkey", "l_linenumber", *NUMBERS), "l_extendedprice", key, 0.1)
    return impute.reconstruct_missing(gaps, NUMBERS)


@query("imputed_ledger")
def imputed_ledger(spark, sf):
    rows = registry(spark, sf).select("title_number", "price_paid", "tenure", "country", "proprietor1")
    return impute.impute_table(rows, numeric=["price_paid"], text=["tenure", "country", "proprietor1"])


@query(
    "pca_impute_facts",
    f"""SELECT count(*) AS num_rows, 0::BIGINT AS missing, count(*) FILTER (kept) AS present, true AS unchanged FROM
      (SELECT {_unit_sql("l_orderkey || '-' || l_linenumber")} >= 0.1 AS kept FROM lineitem)""",
)
def pca_impute_facts(spark, sf):
    """Every gap is filled and no present value is changed."""
    rows = read(spark, sf, "lineitem").withColumn("was", F.col("l_extendedprice"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    done = impute.reconstruct_missing(cleaning.blank_share(rows, "l_extendedprice", key, 0.1), NUMBERS)
    kept = hashed_unit(F.lit(42), key) >= 0.1
    return done.agg(
        F.count("*").alias("num_rows"), F.count_if(F.col("l_extendedprice").isNull()).alias("missing"),
        F.count_if(kept).alias("present"), F.every(~kept | (F.col("l_extendedprice") == F.col("was"))).alias("unchanged"),
    )


@query(
    "imputed_ledger_facts",
    with_views(
        """SELECT count(*) AS num_rows, 0::BIGINT AS missing, count(price_paid) AS prices, count(country) AS countries FROM registry""",
        "registry",
    ),
)
def imputed_ledger_facts(spark, sf):
    """No gap is left, and what was known is as it was."""
    columns = ["price_paid", "tenure", "country", "proprietor1"]
    done = imputed_ledger(spark, sf)
    was = registry(spark, sf).select("title_number", F.col("price_paid").alias("p"), F.col("country").alias("c"))
    missing = sum(F.col(c).isNull().cast("int") for c in columns)
    return done.join(was, "title_number").agg(
        F.count("*").alias("num_rows"), F.sum(missing).alias("missing"),
        F.count_if(F.col("price_paid") == F.col("p")).alias("prices"), F.count_if(F.col("country") == F.col("c")).alias("countries"),
    )


@query(
    "reconstruct_facts",
    with_views(
        f"""SELECT count(*) AS num_rows, count(average_price) FILTER (NOT kept) AS blanked, true AS below_means, true AS below_one_pass, true AS unchanged
        FROM (SELECT *, {_unit_sql("region_name || '-' || date_taken")} >= 0.1 AS kept FROM price_index)""",
        "price_index",
    ),
)
def reconstruct_facts(spark, sf):
    """Known cells are blanked and filled: the rounds err less than column means and than one pass."""
    key = F.concat_ws("-", "region_name", "date_taken")
    index = price_index(spark, sf).select("region_name", "date_taken", *MEASURES)
    rows = index.select("*", F.col("average_price").alias("was"), (hashed_unit(F.lit(42), key) >= 0.1).alias("kept"))
    gaps = cut_lineage(cleaning.blank_share(rows, "average_price", key, 0.1))
    off = F.col("average_price") - F.col("was")
    error = F.sum(F.when(~F.col("kept"), off * off)).alias("error")
    means = cleaning.fill_means(gaps, ["average_price"])
    plain, once = (filled.agg(error).first()["error"] for filled in (means, impute.reconstruct_missing(gaps, MEASURES)))
    return impute.reconstruct_iterated(gaps, MEASURES).agg(
        F.count("*").alias("num_rows"), F.count_if(~F.col("kept") & F.col("was").isNotNull()).alias("blanked"),
        (error < plain).alias("below_means"), (error < once).alias("below_one_pass"),
        F.every(~F.col("kept") | F.col("was").isNull() | (off == 0)).alias("unchanged"),
    )


@query(
    "latent_facts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS num_rows, min({c}) + 0.0 AS low, max({c}) AS high, true AS inside, true AS quartiles_near,
        true AS ranks_near FROM lineitem""" for c in NUMBERS
    ),
)
def latent_facts(spark, sf):
    """Drawn beside given rows: values inside the column's range, its quartiles passed by shares
    within 0.02, rank correlations within 0.08."""
    rows = read(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in NUMBERS])
    # The quantiles of the given rows serve the drawing, the ranks and the quartiles.
    complete = complete_rows(rows, NUMBERS)
    grid = quantile_grid(complete, complete.columns, 1000)
    drawn = cut_lineage(impute.draw_rows(rows, NUMBERS, rows.count(), grid=grid))
    apart = abs(rank_correlations(rows, NUMBERS, grid=grid) - rank_correlations(drawn, NUMBERS)).max(axis=1)
    quartiles = {c: [float(grid[0][i][q]) for q in (250, 500, 750)] for i, c in enumerate(NUMBERS)}

    def facts(df):
        parts = [F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in NUMBERS]
        shares = [F.avg((F.col(c) <= q).cast("int")).alias(f"{c}_{i}") for c, qs in quartiles.items() for i, q in enumerate(qs)]
        return df.agg(*parts, *shares).first()

    given, made = facts(rows), facts(drawn)
    found = [
        (
            c, made[c].n, given[c].low + 0.0, given[c].high, given[c].low <= made[c].low and made[c].high <= given[c].high,
            max(abs(given[f"{c}_{i}"] - made[f"{c}_{i}"]) for i in range(3)) <= 0.02, bool(apart[i] <= 0.08),
        )
        for i, c in enumerate(NUMBERS)
    ]
    return spark.createDataFrame(
        found, "column_name string, num_rows long, low double, high double, inside boolean, quartiles_near boolean, ranks_near boolean"
    )


@query("latent_samples")
def latent_samples(spark, sf):
    rows = read(spark, sf, "lineitem").select(*NUMBERS)
    return impute.draw_rows(rows, NUMBERS, rows.count())


@query(
    "blanked_column",
    f"SELECT * REPLACE (CASE WHEN {_unit_sql('o_orderkey')} >= 0.25 THEN o_totalprice END AS o_totalprice) FROM orders",
)
def blanked_column(spark, sf):
    return cleaning.blank_share(read(spark, sf, "orders"), "o_totalprice", F.col("o_orderkey"), 0.25)


def _drawn_sql(key: str, mean: str) -> str:
    """How often a key is drawn: the steps of the distribution function that its number passes."""
    cdf = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(-({mean})) * pow({mean}, i) / factorial(i::INTEGER)::DOUBLE))"
    return f"len(list_filter(range(0, 21), lambda k: {cdf} < {_unit_sql(key)}))"


@query(
    "bootstrap_sample",
    with_views(
        f"""WITH flagged AS (SELECT * FROM registry WHERE {_OWNER_RULE} = 1),
          share AS (SELECT round((SELECT count(*) FROM flagged) / count(*) * 100, 4) / 100 AS mean FROM registry)
        SELECT title_number, price_paid, unnest(range(1, n + 1)) AS copy FROM
          (SELECT title_number, price_paid, {_drawn_sql('title_number', 'mean')} AS n FROM flagged, share) WHERE n > 0""",
        "registry",
    ),
)
def bootstrap_sample(spark, sf):
    labelled = owner_labelled(spark, sf)
    share = reports.class_share(labelled).first()["flagged_percentage"] / 100
    drawn = sampling.bootstrap(labelled.filter("is_fraud = 1"), share, key=["title_number"])
    copies = drawn.groupBy("title_number", "price_paid").agg(F.count("*").alias("n"))
    return copies.select("title_number", "price_paid", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))


@query(
    "augment_shuffle",
    with_views(
        f"""SELECT region_name, date_taken, 1 + {_drawn_sql("region_name || '|' || date_taken", '0.5::DOUBLE')} AS num_rows
        FROM price_index""",
        "price_index",
    ),
)
def augment_shuffle(spark, sf):
    grown = sampling.augment(price_index(spark, sf), 0.5, key=["region_name", "date_taken"])
    return grown.groupBy("region_name", "date_taken").agg(F.count("*").alias("num_rows"))


@query("augmented_quality")
def augmented_quality(spark, sf):
    rows = owner_labelled(spark, sf).filter("is_fraud = 1").select("tenure", "country", "category")
    return profiling.compare_tables(rows, sampling.augment(rows, 0.5))


@query(
    "train_test_split",
    f"""SELECT part, count(*) AS num_rows FROM
      (SELECT CASE WHEN {_unit_sql('o_orderkey')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders) GROUP BY part""",
)
def train_test_split(spark, sf):
    first, second = sampling.hash_split(read(spark, sf, "orders"), "o_orderkey")
    parts = first.withColumn("part", F.lit("train")).unionByName(second.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(F.count("*").alias("num_rows"))


@query("shuffled_rows", "SELECT c_custkey, c_name FROM customer")
def shuffled_rows(spark, sf):
    return sampling.shuffle_rows(read(spark, sf, "customer").select("c_custkey", "c_name"))
