"""A large forest fitted in parts: each is saved as it ends, so a stopped run goes on where it was.

The parts are forests of their own seeds over the same encoded rows; a prediction is the mean over all trees.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackline.operators.features import CATEGORICAL, LABEL, NUMERIC, training_guards
from trackline.operators.forest import DEPTH, SEED, TREES, encoder
from trackline.session import checkpointed
from trackline.sources.readers import path_exists


@dataclass(frozen=True)
class PartedModel:
    """Stands in for ``DelayModel``: ``predict``, ``score`` and the importances take either."""

    encoding: PipelineModel
    parts: list[RandomForestRegressionModel]

    @property
    def pipeline(self) -> PartedModel:
        return self

    @property
    def forest(self) -> PartedModel:
        return self

    def _labels(self) -> list[tuple[str, str]]:
        encoded = zip(CATEGORICAL, self.encoding.stages[0].labelsArray)
        return [(f"cat__{c}_{v}", c) for c, labels in encoded for v in labels] + [(f"num__{c}", c) for c in NUMERIC]

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self._labels()]

    @property
    def groups(self) -> list[str]:
        return [group for _, group in self._labels()]

    @property
    def featureImportances(self):
        """Mean over the parts, by their trees."""
        total = sum(p.getNumTrees for p in self.parts)
        weighted = [p.featureImportances.toArray() * (p.getNumTrees / total) for p in self.parts]

        class Weights:
            @staticmethod
            def toArray():
                return sum(weighted)

        return Weights

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``predicted_seconds``."""
        out, total = self.encoding.transform(rows), sum(p.getNumTrees for p in self.parts)
        terms: list[Column] = []
        for i, part in enumerate(self.parts):
            out = part.copy().setPredictionCol(f"part_{i}").transform(out)
            terms.append(F.col(f"part_{i}") * part.getNumTrees)
        mean = reduce(lambda a, b: a + b, terms) / total
        return out.withColumn("predicted_seconds", mean).drop(*[f"part_{i}" for i in range(len(self.parts))])


def _settings(spark: SparkSession, folder: str) -> dict | None:
    path = f"{folder}/settings"
    return json.loads(spark.read.text(path).first().value) if path_exists(spark, path) else None


def _note(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def train_parts(
    rows: DataFrame,
    folder: str,
    trees: int = TREES,
    depth: int = DEPTH,
    parts: int = 20,
    seed: int = SEED,
    max_memory_mb: int = 1024,
    max_bins: int = 64,
    guarded: DataFrame | None = None,
) -> PartedModel:
    """Fit encoder and forest over ``rows`` in ``parts`` below ``folder``, which all executors reach.

    Parts that a stopped run left there are kept; a folder fitted with other settings is refused. The rows must be the
    same from run to run. Guards are those of ``forest.train``.
    """
    spark = rows.sparkSession
    guards = training_guards(rows if guarded is None else guarded).first()
    if not guards.trainable:
        raise ValueError(f"cannot train on {guards.n_rows} rows with {guards.n_labels} distinct delays")
    settings = {"trees": trees, "depth": depth, "parts": parts, "seed": seed, "bins": max_bins}
    known = _settings(spark, folder)
    if known is not None and known != settings:
        raise ValueError(f"{folder} holds a forest of other settings: {known}")
    if known is None:
        encoder().fit(rows).write().overwrite().save(f"{folder}/encoder")
        # Written last: a folder with settings has its encoder.
        _note(spark, f"{folder}/settings", json.dumps(settings))
    encoded = None
    for i in range(parts):
        own = trees // parts + (i < trees % parts)
        # A part counts once its mark is there; what an interrupted save left is overwritten.
        if not own or path_exists(spark, f"{folder}/done-{i}"):
            continue
        if encoded is None:
            encoded = checkpointed(PipelineModel.load(f"{folder}/encoder").transform(rows).select("features", LABEL))
        model = RandomForestRegressor(
            featuresCol="features", labelCol=LABEL, predictionCol="predicted_seconds", numTrees=own, maxDepth=depth,
            seed=seed + i, maxMemoryInMB=max_memory_mb, maxBins=max_bins, featureSubsetStrategy="all",
        ).fit(encoded)
        model.write().overwrite().save(f"{folder}/part-{i}")
        _note(spark, f"{folder}/done-{i}", str(own))
    return load_parts(spark, folder)


def load_parts(spark: SparkSession, folder: str) -> PartedModel:
    """The saved forest; one that is not fitted to its end is refused."""
    settings = _settings(spark, folder)
    if settings is None:
        raise ValueError(f"no forest in {folder}")
    used = [i for i in range(settings["parts"]) if settings["trees"] // settings["parts"] or i < settings["trees"] % settings["parts"]]
    missing = [i for i in used if not path_exists(spark, f"{folder}/done-{i}")]
    if missing:
        raise ValueError(f"{len(missing)} parts of the forest in {folder} are not fitted yet")
    return PartedModel(PipelineModel.load(f"{folder}/encoder"), [RandomForestRegressionModel.load(f"{folder}/part-{i}") for i in used])
