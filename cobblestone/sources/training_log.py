"""Training-log text and metric CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EPOCH_FIRST = "epoch"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their place: (file, block, line_no, value).

    A file split is read front to back by one task, so (block start, running id) is
    the order of lines in a file, without numbering the file in one place.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), "value",
    )


def metrics_schema(names) -> T.StructType:
    return T.StructType([T.StructField(EPOCH_FIRST, T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])


def read_metrics(spark: SparkSession, path: str, names) -> DataFrame:
    """Metric CSV with a header; blanks are null."""
    return spark.read.csv(path, header=True, schema=metrics_schema(names))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric CSV in epoch order (range-partitioned sort: the part files follow each other)."""
    metrics.orderBy("epoch").write.mode("overwrite").csv(path, header=True)
