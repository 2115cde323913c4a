"""Shared small tools of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cobblestone.session import cut_lineage

#: Spark drops a query's shuffle files once its result is written; older versions ignore the setting.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files are freed at once."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return cut_lineage(df, label)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once what was read from them is written itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column = "text", seed: int = 0) -> Column:
    """64 bits of a text; equal texts get equal keys, null counts as empty."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.xxhash64(column, F.lit(seed))


def whole(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def picked(batch: pa.RecordBatch, first: int, count: int) -> list[pa.Array]:
    """The columns of some rows of a batch."""
    part = batch.slice(first, count)
    return [part.column(i) for i in range(part.num_columns)]
