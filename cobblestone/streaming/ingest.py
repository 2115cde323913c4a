"""Segment ingest with progress."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from cobblestone.sources.shared_file import write_text
from cobblestone.sources.tile_log import EVERY, Head, TileLog

Progress = Callable[[float | None, str], None]
PROGRESS = "batch bigint, input_rows bigint, tiles bigint, last_arrival bigint, added bigint, done bigint, share double, seconds double"


def tile_stream(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


class ProgressListener(StreamingQueryListener):
    """Turns what Spark measured of every batch into a row of ``<store>/progress`` and a call of ``on_progress``."""

    def __init__(self, log: TileLog, total: int, on_progress: Progress | None):
        self.log, self.total, self.on_progress = log, total, on_progress
        self.name, self.ended = None, threading.Event()
        self.heads: dict[int, Head] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.id) != self.name or "ingest" not in progress.observedMetrics:
            return
        seen = progress.observedMetrics["ingest"]
        if not seen["tiles"]:
            return
        head = self.heads[progress.batchId]
        share = head.done / self.total
        row = dict(batch=progress.batchId, input_rows=progress.numInputRows, tiles=seen["tiles"], last_arrival=seen["last_arrival"],
                   added=head.added, done=head.done, share=share, seconds=progress.batchDuration / 1000)
        write_text(self.log.spark, f"{self.log.store}/progress/{progress.batchId}.json", json.dumps(row))
        if self.on_progress:
            self.on_progress(share, f"batch {progress.batchId} saved")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.name:
            self.ended.set()


@dataclass
class Ingest:
    """A running ingest; ``awaitTermination`` also waits until all progress is told."""

    query: StreamingQuery
    listener: ProgressListener

    def awaitTermination(self, timeout: float = 60) -> None:
        try:
            self.query.awaitTermination()
            self.listener.ended.wait(timeout)
        finally:
            self.listener.log.spark.streams.removeListener(self.listener)


def ingest(
    stream: DataFrame, store: str, checkpoint: str, total_segments: int, on_progress: Progress | None = None, every: int = EVERY
) -> Ingest:
    """Starts the ingest of tiles (city, seg_row, seg_col, arrived, ...): the tile of a segment that arrived last wins."""
    spark = stream.sparkSession
    log = TileLog(spark, store, every)
    listener = ProgressListener(log, total_segments, on_progress)

    def add(batch: DataFrame, batch_id: int) -> None:
        listener.heads[batch_id] = log.commit(batch_id, batch)

    spark.streams.addListener(listener)
    seen = stream.observe("ingest", F.count(F.lit(1)).alias("tiles"), F.max("arrived").alias("last_arrival"))
    writer = seen.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start()
    listener.name = str(query.id)
    return Ingest(query, listener)


def progress(spark: SparkSession, store: str) -> DataFrame:
    """What the listener wrote: a row per batch."""
    return spark.read.schema(PROGRESS).json(f"{store}/progress")
