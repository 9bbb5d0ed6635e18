"""Batch prediction: load a saved model, score a table, write text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import write_predictions
from .gbm import GBM
from .linear import LinearModel


def load_model(spark: SparkSession, path: str, kind: str) -> GBM | LinearModel:
    if kind == "gbm":
        return GBM.load(spark, path)
    if kind == "linear":
        return LinearModel.load(path)
    raise ValueError(f"unknown model kind {kind}")


def batch_predict(spark: SparkSession, model_path: str, kind: str, instances: DataFrame, out_path: str, copy: list[str] | None = None) -> None:
    """Lines of the copied columns and the prediction."""
    write_predictions(load_model(spark, model_path, kind).predict(instances), out_path, [*(copy or []), "prediction"])
