"""Gradient-boosted classification of pairs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that would leak the answer.
FORBIDDEN = {"label", "source1_entity_id", "candidate_entity_id", "is_validation"}


def check_features(frame: DataFrame, features: list[str]) -> None:
    """Raises for repeated, leaking, missing, non-numeric or null features."""
    if len(set(features)) != len(features):
        raise ValueError("repeated features")
    if leaks := FORBIDDEN & set(features):
        raise ValueError(f"leaking features: {sorted(leaks)}")
    kinds = dict(frame.dtypes)
    if bad := [f for f in features if f not in kinds or kinds[f] not in ("int", "bigint", "float", "double", "smallint", "tinyint")]:
        raise ValueError(f"missing or non-numeric features: {bad}")
    counts = frame.agg(*(F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f) for f in features)).first()
    if bad := [f for f in features if counts[f]]:
        raise ValueError(f"features with nulls: {bad}")


def fit(frame: DataFrame, features: list[str], validation_col: str | None = None, rounds: int = 50, depth: int = 5, step: float = 0.05, subsampling: float = 0.8, min_rows: int = 50, seed: int = 42) -> PipelineModel:
    """Boosted trees on the feature columns; with a validation column, rounds stop when its loss does."""
    check_features(frame, features)
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsampling, minInstancesPerNode=min_rows, seed=seed)
    if validation_col:
        trees = trees.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(frame)


def fit_second(frame: DataFrame, features: list[str], trees: int = 100, depth: int = 8, subsampling: float = 0.8, min_rows: int = 5, seed: int = 42) -> PipelineModel:
    """A second, differently biased model for blends: a random forest on the same columns."""
    check_features(frame, features)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, subsamplingRate=subsampling, minInstancesPerNode=min_rows, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(frame)


#: Groups of features whose shares of the gain are told.
GAIN_GROUPS = {
    "country": ("same_country", "country_conflict", "country_missing_left", "country_missing_right"),
    "exact_name": ("name_full_exact", "name_core_exact", "name_sorted_exact"),
    "tfidf": ("name_tfidf_similarity", "name_tfidf_rank", "relative_tfidf_rank"),
    "address_numbers": ("numeric_token_equal", "numeric_token_overlap", "numeric_token_conflict"),
}


def gain_shares(gains: dict[str, float]) -> dict[str, float]:
    """Each group's share of the total gain; 0 where there is none."""
    total = sum(gains.values())
    return {group: sum(gains.get(f, 0.0) for f in own) / total if total else 0.0 for group, own in GAIN_GROUPS.items()}


def predict(model: PipelineModel, frame: DataFrame) -> DataFrame:
    return model.transform(frame).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    found = zip(features, model.stages[-1].featureImportances.toArray().tolist())
    return sorted(found, key=lambda x: (-x[1], x[0]))[:top]


def probability_grid(around: float | None = None) -> list[float]:
    """The coarse grid of thresholds, or the fine one around a value."""
    if around is None:
        return sorted({0.001, 0.002, 0.005, *(round(i / 100, 2) for i in range(1, 100)), 0.995, 0.998, 0.999})
    return [round(around + i * 0.0005, 4) for i in range(-40, 41) if 0 < around + i * 0.0005 < 1]


def dense_grid(low: float = 0.01, high: float = 0.995, steps: int = 500) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    return [low + (high - low) * i / (steps - 1) for i in range(steps)]
