"""Fitted models on shared storage, with what is needed to use them again."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import DataFrame, SparkSession

from gapline.operators.models import Stack


def save_model(model: PipelineModel, path: str, features: Sequence[str], spark: SparkSession,
               accuracy: float | None = None, target_transform: str = "log1p") -> None:
    """Write the pipeline and a one-row metadata table beside it."""
    model.write().overwrite().save(f"{path}/model")
    scalers = [s for s in model.stages if isinstance(s, StandardScalerModel)]
    row = {
        "features": list(features), "target_transform": target_transform, "accuracy": accuracy,
        "scaler_mean": [float(v) for v in scalers[0].mean] if scalers else None,
        "scaler_scale": [float(v) for v in scalers[0].std] if scalers else None,
        "stages": json.dumps([type(s).__name__ for s in model.stages]),
    }
    schema = ("features array<string>, target_transform string, accuracy double, "
              "scaler_mean array<double>, scaler_scale array<double>, stages string")
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def save_stack(stack: Stack, path: str, features: Sequence[str], spark: SparkSession) -> None:
    """Write the base models and the blender of a stack, and the order of the bases."""
    for i, model in enumerate(stack.bases.values()):
        save_model(model, f"{path}/base{i}", features, spark)
    stack.blender.write().overwrite().save(f"{path}/blender")
    spark.createDataFrame(list(enumerate(stack.bases)), "place int, name string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/bases")


def load_stack(spark: SparkSession, path: str) -> Stack:
    names = [r["name"] for r in spark.read.parquet(f"{path}/bases").orderBy("place").collect()]
    return Stack({n: load_model(f"{path}/base{i}") for i, n in enumerate(names)},
                 PipelineModel.load(f"{path}/blender"))


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/metadata")
