"""Live monitor of training logs (T1): epoch metrics and the best epoch per run while the logs are written.

Lines are parsed by Spark; the epoch announced last and the best value of every metric are state of the run, so an epoch
may be announced in one micro-batch and measured in a later one, and no stored batch is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cobblestone.operators import training_log
from cobblestone.sources import growing_logs

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEASURED = "run string, at bigint, place int, epoch int, metric string, value double, best_epoch int, best_value double"


def log_stream(spark: SparkSession, folder: str, piece_bytes: int = growing_logs.PIECE_BYTES) -> DataFrame:
    """Complete lines (run, at, value) of a folder of growing files, one file per run; ``at`` is the line's first byte."""
    growing_logs.register(spark)
    options = {"path": folder, "pieceBytes": piece_bytes, "tasks": 2 * spark.sparkContext.defaultParallelism}
    lines = spark.readStream.format("growing_logs").options(**options).load()
    return lines.withColumnRenamed("file", "run")


def parsed(lines: DataFrame) -> DataFrame:
    """(run, at, place, mark, metric, value): a row per metric of a line, and one per line that announces an epoch."""
    mark = training_log.epoch_of(F.col("value"))
    hits = F.when(F.col("value").contains(training_log.METRIC_MARK), training_log.found_metrics(F.col("value")))
    rows = lines.where(F.col("value").contains(training_log.METRIC_MARK) | mark.isNotNull())
    rows = rows.select("run", "at", mark.alias("mark"), F.posexplode_outer(hits).alias("place", "m"))
    return rows.select("run", "at", F.coalesce("place", F.lit(-1)).alias("place"), "mark", "m.metric", "m.value")


def carried(values: np.ndarray, before: float) -> np.ndarray:
    """The last value that is not NaN up to each place; ``before`` where there is none yet."""
    last = np.maximum.accumulate(np.where(np.isnan(values), -1, np.arange(len(values))))
    return np.where(last < 0, before, values[last])


class RunMonitor(StatefulProcessor):
    """State of a run: the epoch announced last, and the best value of each metric with its epoch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "epoch int")
        self.best = handle.getMapState("best", "metric string", "epoch int, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        order = np.lexsort((batch["place"].to_numpy(), batch["at"].to_numpy()))
        at, mark, value = (batch[c].to_numpy()[order] for c in ("at", "mark", "value"))
        codes, metrics = pd.factorize(batch["metric"].to_numpy()[order])
        epoch = carried(mark.astype("float64"), self.epoch.get()[0] if self.epoch.exists() else np.nan)
        if not np.isnan(epoch[-1]):
            self.epoch.update((int(epoch[-1]),))
        found = np.flatnonzero((codes >= 0) & ~np.isnan(epoch))
        if not found.size:
            return
        found = found[np.argsort(codes[found], kind="stable")]  # metric after metric, each in the order of its lines
        at, epoch, value, codes = at[found], epoch[found], value[found].astype("float64"), codes[found]
        best_epoch, best_value = np.empty(len(found)), np.empty(len(found))
        ends = [*np.flatnonzero(np.diff(codes)) + 1, len(found)]
        for first, end in zip([0, *ends], ends):
            series, metric = slice(first, end), metrics[codes[first]]
            known = self.best.containsKey((metric,))
            known_epoch, known_value = self.best.getValue((metric,)) if known else (np.nan, -np.inf)
            top = np.maximum.accumulate(np.concatenate([[known_value], np.where(np.isnan(value[series]), -np.inf, value[series])]))
            better = top[1:] > top[:-1]
            best_epoch[series] = carried(np.where(better, epoch[series], np.nan), known_epoch)
            best_value[series] = np.where(top[1:] > -np.inf, top[1:], np.nan)
            if better.any():
                self.best.updateValue((metric,), (int(best_epoch[end - 1]), float(top[-1])))
        yield pd.DataFrame({
            "run": key[0], "at": at, "place": batch["place"].to_numpy()[order][found], "epoch": epoch.astype("int32"), "metric": metrics[codes],
            "value": value, "best_epoch": pd.array(best_epoch, "Int32"), "best_value": best_value,
        })

    def close(self) -> None:
        pass


def measured(lines: DataFrame) -> DataFrame:
    """Every metric of a stream of lines with its epoch and the best value and epoch so far (the first one on ties)."""
    return parsed(lines).groupBy("run").transformWithStateInPandas(
        statefulProcessor=RunMonitor(), outputStructType=MEASURED, outputMode="Update", timeMode="None")


def monitor(lines: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Starts the monitor over everything there is; call it again for what was appended since.

    Every micro-batch writes its metrics under ``store``/metrics/batch=<id> and the runs' last bests under
    ``store``/best/batch=<id>. Writing a batch twice replaces it, which makes the sink exactly-once.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.drop("place").persist()
        rows.write.mode("overwrite").parquet(f"{store}/metrics/batch={batch_id}")
        last = F.max_by(F.struct("best_epoch", "best_value", "at"), "at").alias("b")
        rows.groupBy("run", "metric").agg(last).select("run", "metric", "b.*").write.mode("overwrite").parquet(f"{store}/best/batch={batch_id}")
        rows.unpersist()

    conf = lines.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ROCKS)  # the query keeps the setting it was started with
    try:
        writer = measured(lines).writeStream.outputMode("update").foreachBatch(add)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(_STORE) if before is None else conf.set(_STORE, before)


def best_so_far(spark: SparkSession, store: str) -> DataFrame:
    """Best value and epoch of every run and metric; reads a row per run, metric and batch that changed it."""
    last = F.max_by(F.struct("best_epoch", "best_value"), "at").alias("b")
    return spark.read.parquet(f"{store}/best").groupBy("run", "metric").agg(last).select("run", "metric", "b.*")


def metrics_so_far(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/metrics").drop("batch")
