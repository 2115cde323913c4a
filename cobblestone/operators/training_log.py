"""Training logs: metric extraction, learning curves, early-stopping and learning-rate replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.operators.ordered import carry_forward, running

# Line patterns of the log, callback settings.
EPOCH_PATTERN = r"performing (\d+)-th epoch"
METRIC_PATTERN = r"(val_)?is_street[_\w]*:\s*([0-9.eE+-]+)"
METRIC_MARK = "is_street"
STOP_PATIENCE = 20
PLATEAU_PATIENCE = 7
PLATEAU_FACTOR = 0.5
PLATEAU_MIN_DELTA = 1e-4
MIN_RATE = 1e-6
FIRST_RATE = 1e-3


def epoch_of(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, EPOCH_PATTERN, 1), F.lit("")).try_cast("int")


def with_epoch(lines: DataFrame, by: tuple[str, ...] = (), block: int | Column = 1_000_000) -> DataFrame:
    """Lines with the epoch announced last before them."""
    return carry_forward(lines, "line_no", epoch_of(F.col("value")), "epoch", by, block)


def found_metrics(line: Column) -> Column:
    """Metrics of one line as ARRAY<STRUCT<metric, value>>."""
    hits = F.regexp_extract_all(line, F.lit(METRIC_PATTERN), F.lit(0))
    return F.transform(hits, lambda m: F.struct(
        F.trim(F.split(m, ":")[0]).alias("metric"), F.trim(F.split(m, ":")[1]).try_cast("double").alias("value")
    ))


def extract_metrics(lines: DataFrame, by: tuple[str, ...] = (), block: int | Column = 1_000_000) -> DataFrame:
    """Metric values with line and epoch, in long form (L1); lines before the first epoch are left out."""
    marked = with_epoch(lines.where(F.col("value").contains(METRIC_MARK) | epoch_of(F.col("value")).isNotNull()), by, block)
    hits = marked.where(F.col("epoch").isNotNull() & F.col("value").contains(METRIC_MARK))
    return hits.select(*by, "line_no", "epoch", F.explode(found_metrics(F.col("value"))).alias("m")).select(
        *by, "line_no", "epoch", "m.metric", "m.value"
    )


def wide_metrics(metrics: DataFrame, names, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per log line, one column per metric name."""
    return metrics.groupBy(*by, "line_no", "epoch").pivot("metric", list(names)).agg(F.max("value"))


def learning_curve(metrics: DataFrame, train: str, validation: str) -> DataFrame:
    """Training and validation value per epoch, the best validation epoch marked (L2)."""
    curve = metrics.where(F.col("metric").isin(train, validation)).groupBy("epoch").pivot(
        "metric", [train, validation]
    ).agg(F.max("value")).withColumnsRenamed({train: "train", validation: "validation"})
    best = curve.agg(F.min_by("epoch", F.struct(-F.col("validation"), "epoch")).alias("best_epoch"))  # one row
    return curve.join(F.broadcast(best)).select(
        "epoch", "train", "validation", (F.col("epoch") == F.col("best_epoch")).alias("is_best")
    )


def best_epoch(metrics: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Epoch of the largest value per series, the first one on ties."""
    rank = F.struct(-F.col("value"), F.col("epoch"))
    best = F.min_by(F.struct("epoch", "value"), rank)
    return metrics.where(F.col("value").isNotNull()).groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.epoch").alias("best_epoch"), F.col("b.value").alias("best_value")
    )


def since_best(metrics: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Per epoch: best value so far, its epoch, and the number of epochs since."""
    ranked = running(metrics, "epoch", F.col("value"), "before", "max", by, exclusive=True)
    counted = running(ranked, "epoch", F.lit(1), "n", "sum", by)
    improved = F.coalesce(F.col("value") > F.col("before"), F.col("value").isNotNull() & F.col("before").isNull())
    mark = F.when(improved, F.struct("n", F.col("epoch").alias("e"), F.col("value").alias("v")))
    seen = carry_forward(counted, "epoch", mark, "best", by)
    return seen.select(
        *by, "epoch", "value", F.col("best.e").alias("best_epoch"), F.col("best.v").alias("best_value"),
        (F.col("n") - F.coalesce("best.n", F.lit(0))).alias("since_best"),
    )


def early_stop(metrics: DataFrame, patience: int = STOP_PATIENCE, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Where training would stop and which epoch it would restore (W5); null without a stop."""
    state = since_best(metrics, by)
    stopped = F.when(F.col("since_best") >= patience, F.struct("epoch", "best_epoch", "best_value"))
    return state.groupBy(*by).agg(F.min(stopped).alias("s")).select(
        *by, F.col("s.epoch").alias("stop_epoch"), F.col("s.best_epoch").alias("best_epoch"), F.col("s.best_value").alias("best_value")
    )


def _improvements(metrics: DataFrame, by: tuple[str, ...], min_delta: float) -> DataFrame:
    """Epochs that beat the last accepted best by more than ``min_delta``.

    Only epochs above everything before them can do so; these few are folded in order
    per series (one training run), everything else stays distributed.
    """
    ranked = running(metrics, "epoch", F.col("value"), "before", "max", by, exclusive=True)
    records = ranked.where(F.col("before").isNull() | (F.col("value") > F.col("before")))
    listed = records.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("epoch", "value"))).alias("r"))
    none = F.array().cast(metrics.select(F.array("epoch")).schema[0].dataType)
    start = F.struct(F.lit(float("-inf")).alias("best"), none.alias("at"))
    folded = F.aggregate("r", start, lambda acc, x: F.when(
        x["value"] > acc["best"] + min_delta, F.struct(x["value"].alias("best"), F.concat(acc["at"], F.array(x["epoch"])).alias("at"))
    ).otherwise(acc))
    return listed.select(*by, F.explode(folded["at"]).alias("epoch"))


def plateau_rates(
    metrics: DataFrame, first_rate: float = FIRST_RATE, patience: int = PLATEAU_PATIENCE, factor: float = PLATEAU_FACTOR,
    min_rate: float = MIN_RATE, min_delta: float = PLATEAU_MIN_DELTA, by: tuple[str, ...] = ("metric",),
) -> DataFrame:
    """Learning rate after every epoch when it is cut on plateaus.

    Between two improvements the rate is cut once per ``patience`` epochs, so the
    number of cuts is a sum of whole quotients and the rate follows in closed form.
    """
    better = _improvements(metrics, by, min_delta).withColumn("improved", F.lit(True))
    marked = running(metrics, "epoch", F.lit(1), "n", "sum", by).join(better, [*by, "epoch"], "left")
    seen = carry_forward(marked, "epoch", F.when(F.col("improved"), F.col("n")), "from_n", by)
    waited = F.col("n") - F.coalesce("from_n", F.lit(0))
    cut = F.when((waited > 0) & (waited % patience == 0), F.lit(1)).otherwise(F.lit(0))
    counted = running(seen.withColumn("cut", cut), "epoch", F.col("cut"), "cuts", "sum", by)
    rate = F.greatest(F.lit(first_rate) * F.pow(F.lit(factor), F.col("cuts")), F.lit(min_rate))
    return counted.select(*by, "epoch", "value", "cuts", rate.alias("rate"))


def latest_file(listing: DataFrame, by: str) -> DataFrame:
    """Newest file per folder by the text before its first underscore (W7), compared as text."""
    return listing.groupBy(by).agg(F.max_by("file", F.struct(F.split("file", "_")[0], "file")).alias("file"))
