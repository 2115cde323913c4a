"""Grid tiles and cells as partitioned Parquet (S4): rewriting a segment touches only its partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Writer options for rows that hold a tile each. A reader makes arrays of 4,096 rows or a row group, whichever is less, and a
#: row group has 128 MB as stored, which may be thousands of tiles: their values compress well.
TILE_FILES = {"parquet.block.row.count.limit": "8"}


def array_files(values: int) -> dict[str, str]:
    """Writer options for rows with arrays of so many values in all: about two million values to a row group, but eight rows."""
    return {"parquet.block.row.count.limit": str(max(8, 2**21 // values))}



def write_tiles(tiles: DataFrame, path: str) -> None:
    """Writes tiles (city, seg_row, seg_col, ...); segments already stored are replaced, others stay."""
    keys = ["city", "seg_row", "seg_col"]
    (
        tiles.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .options(**TILE_FILES).partitionBy(*keys).parquet(path)
    )


def read_tiles(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    """Stored tiles; filters on city, seg_row and seg_col prune partitions."""
    tiles = spark.read.parquet(path)
    return tiles if city is None else tiles.where(tiles.city == city)
