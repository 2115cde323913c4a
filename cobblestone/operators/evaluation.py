"""Segmentation and regression metrics as combinable aggregates per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Smoothing, clipping, focal and dice weights, thresholds, loss weights.
DICE_SMOOTH = 1e-6
PROBABILITY_FLOOR = 1e-7
FOCAL_GAMMA = 2.0
DICE_WEIGHT = 0.5
PR_THRESHOLDS = 200
HUBER_DELTA = 1.0
LOSS_WEIGHTS = {"is_street": 10.0, "altitude": 1.0, "is_residential": 10.0}


def dice(y: Column, p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return (2 * F.sum(y * clipped) + DICE_SMOOTH) / (F.sum(y) + F.sum(clipped) + DICE_SMOOTH)


def focal(y: Column, p: Column, gamma: float = FOCAL_GAMMA) -> Column:
    """Mean binary focal cross-entropy without class balancing."""
    safe = F.least(F.greatest(p, F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    entropy = -(y * F.log(safe) + (1 - y) * F.log(1 - safe))
    right = y * p + (1 - y) * (1 - p)
    return F.avg(F.pow(1 - right, F.lit(gamma)) * entropy)


def focal_dice(y: Column, p: Column) -> Column:
    return focal(y, p) + DICE_WEIGHT * (1 - dice(y, p))


def precision(y: Column, p: Column, threshold: float = 0.5) -> Column:
    called = F.count_if(p > threshold)
    return F.coalesce(F.count_if((p > threshold) & (y > 0)) / F.nullif(called, F.lit(0)), F.lit(0.0))


def recall(y: Column, p: Column, threshold: float = 0.5) -> Column:
    real = F.count_if(y > 0)
    return F.coalesce(F.count_if((p > threshold) & (y > 0)) / F.nullif(real, F.lit(0)), F.lit(0.0))


def huber(y: Column, p: Column, delta: float = HUBER_DELTA) -> Column:
    error = F.abs(y - p)
    return F.avg(F.when(error <= delta, error * error / 2).otherwise(delta * error - delta * delta / 2))


def binary_report(scores: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """Dice, dice loss, focal + dice loss, precision and recall in one pass."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    return scores.groupBy(*by).agg(
        dice(a, b).alias("dice"), (1 - dice(a, b)).alias("dice_loss"), focal_dice(a, b).alias("focal_dice_loss"),
        precision(a, b).alias("precision"), recall(a, b).alias("recall"),
    )


def regression_report(scores: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """MAE, RMSE and Huber loss."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    return scores.groupBy(*by).agg(
        F.avg(F.abs(a - b)).alias("mae"), F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"), huber(a, b).alias("huber")
    )


def total_loss(scores: DataFrame, *by: str) -> DataFrame:
    """Weighted loss over street, altitude and residential outputs (columns y_<name>, p_<name>)."""
    terms = [
        weight * (huber(F.col(f"y_{name}"), F.col(f"p_{name}")) if name == "altitude" else focal_dice(F.col(f"y_{name}"), F.col(f"p_{name}")))
        for name, weight in LOSS_WEIGHTS.items()
    ]
    return scores.groupBy(*by).agg((terms[0] + terms[1] + terms[2]).alias("loss"))


def pr_auc(scores: DataFrame, y: str, p: str, *by: str, thresholds: int = PR_THRESHOLDS) -> DataFrame:
    """Interpolated area under the precision-recall curve over evenly spaced thresholds.

    Scores are first counted per threshold bucket, so the cumulative window sees at
    most ``thresholds`` rows per group.
    """
    bucket = F.greatest(F.ceil(F.col(p) * (thresholds - 1)) - 1, F.lit(0))
    counted = scores.groupBy(*by, bucket.alias("bucket")).agg(
        F.count_if(F.col(y) > 0).alias("dtp"), F.count("*").alias("dp")
    )
    down = Window.partitionBy(*by).orderBy(F.desc("bucket"))
    every = Window.partitionBy(*by)
    summed = counted.withColumns({
        "tp": F.sum("dtp").over(down) - F.col("dtp"), "called": F.sum("dp").over(down) - F.col("dp"),
        "positives": F.sum("dtp").over(every),
    })
    slope = F.col("dtp") / F.col("dp")
    ratio = F.coalesce((F.col("called") + F.col("dp")) / F.nullif(F.col("called"), F.lit(0)), F.lit(1.0))
    step = slope * (F.col("dtp") + (F.col("tp") - slope * F.col("called")) * F.log(ratio))
    area = F.sum(step) / F.nullif(F.max("positives"), F.lit(0))
    return summed.groupBy(*by).agg(F.coalesce(area, F.lit(0.0)).alias("pr_auc"))
