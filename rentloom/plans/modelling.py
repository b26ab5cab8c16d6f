"""Cluster the listings, fit one boosted model per cluster and score the held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.operators.model import (
    FeaturePipeline, add_error, background_rows, cluster, evaluate, fit_per_cluster, pca_reduce, predict_per_cluster,
    shapley_importance,
)
from rentloom.operators.sampling import train_test_split
from rentloom.session import checkpointed


class ModelRun(NamedTuple):
    """Scored test rows, their metrics, the per-cluster models and the fitted pipeline."""

    predictions: DataFrame
    metrics: DataFrame
    models: dict
    pipeline: FeaturePipeline
    train: DataFrame


def clustered_listings(df: DataFrame, row_id: str, pipeline: FeaturePipeline, clusters: int = 3, components: int = 3) -> DataFrame:
    features = pipeline.transform(df)
    return checkpointed(cluster(pca_reduce(features, k=components), k=clusters))


def run_model(df: DataFrame, row_id: str, target: str, categoricals: Sequence[str], numerics: Sequence[str],
              fraction: float = 0.8, rounds: int = 200, clusters: int = 3, seed: int = 42, fit_on_all: bool = False) -> ModelRun:
    """``fit_on_all`` fits the encoder on all rows before the split instead of on the training rows."""
    split = checkpointed(train_test_split(df, row_id, fraction, seed))
    pipeline = FeaturePipeline(categoricals, numerics).fit(split if fit_on_all else split.where("is_train"))
    rows = clustered_listings(split, row_id, pipeline, clusters)
    train, test = rows.where("is_train"), rows.where("NOT is_train")
    models = fit_per_cluster(train, target, rounds=rounds, seed=seed)
    predicted = predict_per_cluster(test, models).withColumn("Actual", F.col(target))
    predicted = add_error(predicted)
    return ModelRun(predicted, evaluate(predicted, "Predicted", "Actual"), models, pipeline, train)


def explain_cluster(run: ModelRun, row_id: str, group: int, permutations: int = 4, seed: int = 42) -> DataFrame:
    """Attributions of one cluster's test rows, one feature per source column."""
    columns = [*run.pipeline.categoricals, *run.pipeline.numerics]
    model = run.models[group]

    def score(steps: DataFrame) -> DataFrame:
        return model.transform(run.pipeline.transform(steps))

    rows = run.predictions.where(F.col("Cluster") == group)
    background = background_rows(run.train.where(F.col("Cluster") == group), row_id, columns, seed=seed)
    return shapley_importance(rows, row_id, columns, score, background, permutations, seed)


def explain_clusters(run: ModelRun, row_id: str, permutations: int = 4, seed: int = 42) -> DataFrame:
    """Attributions of the test rows of every cluster with a model, with their ``Cluster``."""
    parts = [explain_cluster(run, row_id, g, permutations, seed).withColumn("Cluster", F.lit(g)) for g in sorted(run.models)]
    return reduce(DataFrame.unionByName, parts)
