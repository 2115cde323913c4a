"""Endless stream of training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cobblestone.operators import sampling
from cobblestone.session import cut_lineage
from cobblestone.sources.tiles import array_files


def sample_stream(spark: SparkSession, per_batch: int) -> DataFrame:
    """Ever-growing sample ids, ``per_batch`` per micro-batch."""
    ids = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).load()
    return ids.select(F.col("value").alias("sample_id"))


def generate(
    stream: DataFrame, grids: DataFrame, cells: DataFrame, shape: sampling.SampleShape, cut: tuple[int, int],
    store: str, checkpoint: str, endless: bool = True,
):
    """Starts the generator: every micro-batch writes its samples under ``store``/batch=<id>.

    ``stream`` is any stream of sample_id; unless ``endless``, it stops at the end of what is there.
    """

    files = array_files(shape.size**2 * (shape.inputs + shape.outputs))
    blocks = cut_lineage(sampling.sample_blocks(cells, shape), "sample-blocks", **files)  # the raster is read once, not per batch

    def add(batch: DataFrame, batch_id: int) -> None:
        windows = sampling.sample_windows(sampling.random_cuts(batch, grids, *cut), shape)
        sampling.sample_arrays(windows, None, shape, blocks=blocks).write.mode("overwrite").options(**files).parquet(f"{store}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer if endless else writer.trigger(availableNow=True)).start()
