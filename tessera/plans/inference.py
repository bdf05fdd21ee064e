"""Predictions with a run's artifacts, for one image or many."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import extract, feature_columns
from ..functions.learners import PivotModel, load_model
from ..sources import artifacts as A
from .settings import Run
from .training import predict


class Bundle(NamedTuple):
    run: Run
    model: object
    labels: list[str]
    thresholds: dict[str, float] | None


def load(spark: SparkSession, folder: str) -> Bundle:
    """A run's artifacts. The stored feature names must be those that the stored configuration makes."""
    own = A.Artifacts(spark, folder)
    run = Run.from_json(own.read(A.CONFIG).decode())
    model = load_model(own.read(A.MODEL))
    if own.read_json(A.COLUMNS) != feature_columns(run.texture):
        raise ValueError("the stored feature columns aren't those of the stored configuration")
    labels = own.read_json(A.LABELS) if own.exists(A.LABELS) else model.classes
    limits = own.read_json(A.THRESHOLDS) if own.exists(A.THRESHOLDS) and isinstance(model, PivotModel) else None
    return Bundle(run, model, labels, limits)


def predict_images(images: DataFrame, bundle: Bundle) -> DataFrame:
    """``images`` (with Spark's ``image`` struct) with ``pred`` and ``probabilities`` (class to number, null if the model
    has none), and without ``image``."""
    scored = predict(extract(images, bundle.run), bundle.model, bundle.labels, bundle.thresholds)
    names = F.array(*[F.lit(k) for k in bundle.labels])
    return scored.withColumn("probabilities", F.when(F.col("probs").isNotNull(), F.map_from_arrays(names, "probs"))).drop("features", "probs")


def predict_one(spark: SparkSession, folder: str, image_path: str) -> dict:
    """``prediction`` and, if the model has them, ``probabilities`` of one image."""
    images = spark.read.format("image").option("dropInvalid", False).load(str(image_path))
    row = predict_images(images, load(spark, folder)).first()
    if row is None:
        raise FileNotFoundError(image_path)
    out: dict = {"prediction": row["pred"]}
    if row["probabilities"] is not None:
        out["probabilities"] = {k: float(v) for k, v in row["probabilities"].items()}
    return out


def as_json(result: dict) -> str:
    return json.dumps(result, ensure_ascii=False, indent=2)
