"""Small text files in any store Spark can write to, through its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes or replaces a file, by renaming a complete one."""
    store, place = _place(spark, path)
    part = place.suffix(".part")
    out = store.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    store.delete(place, False)
    if not store.rename(part, place):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; None if there is no such file."""
    store, place = _place(spark, path)
    if not store.exists(place):
        return None
    file = store.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()
    finally:
        file.close()
