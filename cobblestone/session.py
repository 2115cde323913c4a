"""Session settings and lineage cutting shared by the iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What decides on broadcasts. Files of cells hold a hundredth of the bytes of their rows, and estimates do not count what an
# explode adds, so the size of a scan or a view says nothing: a side is broadcast by hint, or once its shuffled rows are small.
JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # a table with few keys leaves most partitions empty and is broadcast all the same
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
}

# Rows with whole tiles in them: batches to Python go by bytes, not by 10,000 rows. Both sides hold a batch, more than once.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "16m"}

# Settings every job here relies on; executors, memory and parallelism stay with the cluster.
SETTINGS = {
    **JOINS,
    **BATCHES,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "cobblestone", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(spark: SparkSession) -> SparkSession:
    """Sets ``JOINS`` and ``BATCHES`` on a session that somebody else has made."""
    for key, value in {**JOINS, **BATCHES}.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only when the setting is absent and the master is
    local (tests, laptops): on a cluster a machine-local folder would not survive
    the loss of an executor, so the job refuses to start instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="cobblestone-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/cobblestone/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    One evaluation, and a durable result if executors are lost. The size of its files is far below that of its rows,
    so joins must not be planned by it (``JOINS``). ``options`` are those of the writer.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
