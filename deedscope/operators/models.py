"""Classification with Spark ML and an exact, distributed area under the ROC curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedscope.operators.features import categories, label_positions, string_index
from deedscope.plans.lineage import cut_lineage
from deedscope.plans.ordinal import with_running_totals


def feature_stages(
    categorical: Sequence[str], numeric: Sequence[str], *, invalid: str = "skip", one_hot: bool = True
) -> list:
    """Index, optionally encode, and assemble the columns into ``features``.

    The labels of these columns live on the driver, so they must be few: check with
    ``categories`` and use ``features.string_index`` for wide columns.
    """
    indexed = [f"{c}_index" for c in categorical]
    encoded = [f"{c}_vec" for c in categorical]
    stages: list = []
    if categorical:
        stages.append(
            StringIndexer(
                inputCols=list(categorical), outputCols=indexed, handleInvalid=invalid,
                stringOrderType="frequencyDesc",
            )
        )
        if one_hot:
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded))
    inputs = [*(encoded if one_hot else indexed), *numeric]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip"))
    return stages


def wide_features(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], *, output: str = "features", drop_last: bool = True
) -> DataFrame:
    """Sparse feature vectors with a place for each label of columns of any width.

    Labels are numbered by falling frequency in a distributed sort and joined to the rows, so none
    of them is on the driver; a vector holds one place per column. Rows with a NULL label or number
    are dropped. As in ``feature_stages``, the rarest label of a column has no place of its own.
    """
    indexed, encoded = [f"__{c}_index" for c in categorical], [f"__{c}_vec" for c in categorical]
    rows = df
    for column, index in zip(categorical, indexed, strict=True):
        rows = string_index(rows, column, output=index, positions=cut_lineage(label_positions(df, column)))
    if categorical:
        # The encoder reads how many labels there are from the indices; rows are read twice.
        rows = cut_lineage(rows)
        rows = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=drop_last).fit(rows).transform(rows)
    assembler = VectorAssembler(inputCols=[*encoded, *numeric], outputCol=output, handleInvalid="skip")
    return assembler.transform(rows).drop(*indexed, *encoded)


def vector_cells(df: DataFrame, keys: Sequence[str], vector: str = "features") -> DataFrame:
    """The non-zero places of sparse vectors as rows: keys, position from 0, value."""
    inner = F.unwrap_udt(vector)
    cells = F.arrays_zip(inner["indices"].alias("position"), inner["values"].alias("value"))
    dense = F.transform(inner["values"], lambda v, i: F.struct(i.alias("position"), v.alias("value")))
    each = F.explode(F.when(inner["type"] == 0, cells).otherwise(dense)).alias("cell")
    rows = df.select(*keys, each)
    return rows.select(*keys, F.col("cell.position").alias("position"), F.col("cell.value").alias("value")).filter("value <> 0")


def fit_forest(
    df: DataFrame, *, label: str, categorical: Sequence[str], numeric: Sequence[str],
    trees: int = 100, depth: int = 5, seed: int = 42, max_categories: int = 1_000,
) -> PipelineModel:
    """A random forest. Keep ``df`` first: it is read many times."""
    categories(df, categorical, max_categories)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[*feature_stages(categorical, numeric), forest]).fit(df)


def train_forest(
    df: DataFrame, *, label: str, categorical: Sequence[str], numeric: Sequence[str], share: float = 0.8,
    seed: int = 42, **options,
) -> tuple[PipelineModel, DataFrame]:
    """A random forest of a share of the rows, and one row with its train and test AUC.

    The needed columns are checkpointed first: a split by random numbers only stays the same when
    the rows are not computed anew. The areas are exact, over all distinct scores.
    """
    rows = cut_lineage(df.select(*categorical, *numeric, label))
    train, test = rows.randomSplit([share, 1 - share], seed)
    model = fit_forest(train, label=label, categorical=categorical, numeric=numeric, seed=seed, **options)
    areas = [
        area_under_roc(scored_table(model, part, [], label), label, "probability").select(F.col("auc").alias(name))
        for part, name in ((train, "train_auc"), (test, "test_auc"))
    ]
    # One row each.
    values = [area.first()[0] for area in areas]
    return model, df.sparkSession.createDataFrame([tuple(values)], "train_auc double, test_auc double")


def forest_auc(df: DataFrame, **options) -> DataFrame:
    """One row: the areas under the ROC curve of a forest on its own rows and on those held out."""
    return train_forest(df, **options)[1]


def scored_table(model: PipelineModel, df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Keys, label, prediction and the probability of class 1 side by side."""
    return model.transform(df).select(
        *keys, label, "prediction", F.element_at(vector_to_array("probability"), 2).alias("probability")
    )


def area_under_roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """The share of (positive, negative) pairs ranked rightly, ties counting half; one row.

    Rows are summed per score first; running totals over the distinct scores replace both the
    sort of all rows and any pairing of them.
    """
    per_score = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("positive"),
            F.count_if(F.col(label) == 0).alias("negative"),
        )
    )
    running = with_running_totals(per_score, [F.asc("score")], {"negative_so_far": F.col("negative")})
    won = F.col("positive") * (F.col("negative_so_far") - F.col("negative") / 2)
    return running.agg(
        F.sum("positive").alias("positives"),
        F.sum("negative").alias("negatives"),
        (F.sum(won) / (F.sum("positive").cast("double") * F.sum("negative"))).alias("auc"),
    )
