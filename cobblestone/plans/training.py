"""A distributed in-painting baseline: border features per hidden cell and logistic regression (M5), and the fitted model as a
predictor of tiled inference (M6)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cobblestone.operators import evaluation
from cobblestone.operators.sampling import SampleShape
from cobblestone.plans.inference import neighbourhood_share

FEATURES = ["left", "right", "above", "below", "row_known", "col_known", "depth"]


def border_features(samples: DataFrame, windows: DataFrame, shape: SampleShape) -> DataFrame:
    """One row per hidden cell of every sample with features of the known street border around it.

    Whether the street touches the hidden area level with the cell on each side, how
    much street lies in its row and column of the border, and how deep inside it is.
    """
    low, high = shape.crop, shape.size - shape.crop - 1
    known = samples.where((F.col("is_predicted") == 0) & (F.col("is_street") > 0))
    by_row = known.groupBy("sample_id", "row").agg(
        F.max((F.col("col") == low - 1).cast("double")).alias("left"), F.max((F.col("col") == high + 1).cast("double")).alias("right"),
        F.count("*").cast("double").alias("row_known"))
    by_col = known.groupBy("sample_id", "col").agg(
        F.max((F.col("row") == low - 1).cast("double")).alias("above"), F.max((F.col("row") == high + 1).cast("double")).alias("below"),
        F.count("*").cast("double").alias("col_known"))
    inside = F.sequence(F.lit(low), F.lit(high))
    hidden = windows.select("sample_id", F.explode(inside).alias("row")).select("*", F.explode(inside).alias("col"))
    truth = samples.where("is_predicted = 1").select("sample_id", "row", "col", F.col("y_is_street").alias("label"))
    depth = F.least(F.col("row") - low, F.lit(high) - F.col("row"), F.col("col") - low, F.lit(high) - F.col("col")).cast("double")
    joined = hidden.join(truth, ["sample_id", "row", "col"], "left").join(by_row, ["sample_id", "row"], "left").join(by_col, ["sample_id", "col"], "left")
    return joined.withColumn("depth", depth).na.fill(0.0, ["label", *FEATURES])


def fit(train: DataFrame, iterations: int = 20):
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"), LogisticRegression(labelCol="label", maxIter=iterations)]
    return Pipeline(stages=stages).fit(train)


def evaluate(model, validation: DataFrame) -> DataFrame:
    """Dice, focal + dice loss, precision, recall and PR-AUC on held-out samples."""
    scored = model.transform(validation).withColumn("p", vector_to_array("probability")[1]).select("label", "p").withColumn("run", F.lit("validation"))
    report = evaluation.binary_report(scored, "label", "p", "run")
    return report.join(evaluation.pr_auc(scored, "label", "p", "run"), "run")


def by_city(features: DataFrame, windows: DataFrame, held_out: DataFrame):
    """(train, validation) rows of features; a city (``held_out`` names some) is on one side only, so windows never overlap both."""
    named = features.join(windows.select("sample_id", "city"), "sample_id")
    cities = held_out.select("city").distinct()
    return named.join(cities, "city", "left_anti"), named.join(cities, "city", "left_semi")


def tile_features(x: np.ndarray, shape: SampleShape) -> np.ndarray:
    """``border_features`` of whole tiles (tiles, size, size, inputs): (tiles, inner, inner, features)."""
    low, high = shape.crop, shape.size - shape.crop - 1
    known = ((x[..., 0] == 0) & (x[..., 1] > 0)).astype(float)
    inside = slice(low, high + 1)
    tall, wide = known[:, inside, :], known[:, :, inside]
    inner = high - low + 1
    place = np.minimum(np.arange(inner), inner - 1 - np.arange(inner)).astype(float)
    depth = np.broadcast_to(np.minimum(place[:, None], place[None, :]), (len(x), inner, inner))
    by_row = [np.broadcast_to(v[:, :, None], depth.shape) for v in (tall[:, :, low - 1], tall[:, :, high + 1])]
    by_col = [np.broadcast_to(v[:, None, :], depth.shape) for v in (wide[:, low - 1, :], wide[:, high + 1, :])]
    sums = [np.broadcast_to(tall.sum(2)[:, :, None], depth.shape), np.broadcast_to(wide.sum(1)[:, None, :], depth.shape)]
    return np.stack([*by_row, *by_col, *sums, depth], axis=-1)


@dataclass(frozen=True)
class StreetModel:
    """A fitted model as a predictor (U1): as many numbers as features, shipped with the tasks and evaluated on whole tiles.

    The street channel is the model's probability; the other channels are those of the neighbourhood.
    """

    weights: tuple[float, ...]
    intercept: float

    @classmethod
    def of(cls, fitted) -> StreetModel:
        regression = fitted.stages[-1]
        return cls(tuple(float(w) for w in regression.coefficients), float(regression.intercept))

    def __call__(self, x: np.ndarray, shape: SampleShape) -> np.ndarray:
        y = neighbourhood_share(x, shape)
        z = tile_features(x, shape) @ np.array(self.weights) + self.intercept
        y[..., 0] = 1 / (1 + np.exp(-z))
        return y
