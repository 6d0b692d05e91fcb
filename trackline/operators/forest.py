"""Delay model: stable split, one-hot encoded random forest, evaluation, scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from trackline.functions import time_bucket
from trackline.operators.features import CATEGORICAL, FEATURES, LABEL, NUMERIC, training_guards
from trackline.session import checkpointed

SEED = 42
TRAIN_PERCENT = 80
# Forest size used in production; pass smaller values for a quick model.
TREES = 400
DEPTH = 16


@dataclass(frozen=True)
class DelayModel:
    pipeline: PipelineModel
    names: list[str]
    groups: list[str]

    @property
    def forest(self):
        return self.pipeline.stages[-1]


def model_rows(features: DataFrame) -> DataFrame:
    """The feature table materialised: id, features and label."""
    return checkpointed(features.select("row_id", *FEATURES, LABEL))


def split(rows: DataFrame, percent: int = TRAIN_PERCENT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, chosen by the first 32 bits of the MD5 of ``row_id`` and the seed."""
    digest = F.substring(F.md5(F.concat(F.col("row_id").cast("string"), F.lit(f"/{seed}"))), 1, 8)
    slot = F.conv(digest, 16, 10).cast("long") % 100
    return rows.filter(slot < percent), rows.filter(slot >= percent)


def encoder() -> Pipeline:
    """Categories to one-hot vectors in alphabetical order, joined with the numbers."""
    indexes = [f"{c}_index" for c in CATEGORICAL]
    vectors = [f"{c}_vector" for c in CATEGORICAL]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=CATEGORICAL, outputCols=indexes, handleInvalid="keep", stringOrderType="alphabetAsc"),
            # The extra index for unseen categories is the dropped last one: all zeros.
            OneHotEncoder(inputCols=indexes, outputCols=vectors, dropLast=True),
            VectorAssembler(inputCols=vectors + NUMERIC, outputCol="features"),
        ]
    )


def train(
    rows: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
    max_memory_mb: int = 1024,
    max_bins: int = 64,
    guarded: DataFrame | None = None,
) -> DelayModel:
    """Fit encoder and forest; every split tries all features.

    Refuses tables too small or without label variation: ``guarded``, the whole table that
    ``rows`` is a part of, or else ``rows`` itself. ``max_bins`` bounds the split points
    tried per numeric feature.
    """
    guards = training_guards(rows if guarded is None else guarded).first()
    if not guards.trainable:
        raise ValueError(f"cannot train on {guards.n_rows} rows with {guards.n_labels} distinct delays")
    regressor = RandomForestRegressor(
        featuresCol="features",
        labelCol=LABEL,
        predictionCol="predicted_seconds",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        maxMemoryInMB=max_memory_mb,
        maxBins=max_bins,
        featureSubsetStrategy="all",
    )
    encoding = encoder().fit(rows)
    # The forest reads its rows three times before it keeps them in its own form.
    encoded = encoding.transform(rows).select("features", LABEL).persist(StorageLevel.DISK_ONLY)
    model = PipelineModel([*encoding.stages, regressor.fit(encoded)])
    encoded.unpersist()
    names, groups = [], []
    for column, labels in zip(CATEGORICAL, model.stages[0].labelsArray):
        names += [f"cat__{column}_{value}" for value in labels]
        groups += [column] * len(labels)
    return DelayModel(model, names + [f"num__{c}" for c in NUMERIC], groups + NUMERIC)


def predict(model: DelayModel, rows: DataFrame) -> DataFrame:
    """Input columns plus ``predicted_seconds``."""
    return model.pipeline.transform(rows).select(*rows.columns, "predicted_seconds")


def actual_vs_predicted(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        (F.col(LABEL) / 60).alias("actual_delay_min"), (F.col("predicted_seconds") / 60).alias("predicted_delay_min")
    )


def regression_metrics(predictions: DataFrame, actual: str = LABEL, predicted: str = "predicted_seconds") -> DataFrame:
    """MAE and RMSE in minutes and R², one row."""
    error = F.col(actual) - F.col(predicted)
    squares = F.sum(error * error)
    return predictions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.avg(F.abs(error)) / 60).alias("mae_min"),
        (F.sqrt(squares / F.count(F.lit(1))) / 60).alias("rmse_min"),
        (1 - squares / F.nullif(F.var_pop(actual) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
    )


def feature_importance(model: DelayModel, spark) -> DataFrame:
    """Importance per encoded feature with its root variable, highest first."""
    weights = [float(w) for w in model.forest.featureImportances.toArray()]
    rows = list(zip(model.names, model.groups, weights))
    return spark.createDataFrame(rows, "feature string, group string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    """Highest ``n``, shown in ascending order."""
    name = importance.columns[0]
    return importance.orderBy(F.desc("importance"), name).limit(n).orderBy("importance", F.desc(name))


def grouped_importance(importance: DataFrame) -> DataFrame:
    """Importance summed over the encoded columns of each root variable."""
    return (
        importance.groupBy("group")
        .agg(F.sum("importance").alias("importance"))
        .orderBy(F.desc("importance"), "group")
    )


def score(model: DelayModel, records: DataFrame) -> DataFrame:
    """Predicted delay for new records; missing calendar helpers are derived."""
    rows = records
    if "time_bucket" not in rows.columns:
        rows = rows.withColumn("time_bucket", time_bucket(F.col("hour")))
    if "is_weekend" not in rows.columns:
        rows = rows.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
    return predict(model, rows).withColumn("predicted_minutes", F.col("predicted_seconds") / 60)
