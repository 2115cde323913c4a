"""Cell, segment and window arithmetic on city rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHANNELS = ("is_street", "altitude", "is_residential")

ORTHOGONAL = ((-1, 0), (0, -1), (0, 1), (1, 0))
CROSS = ((0, 0),) + ORTHOGONAL
AROUND = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))
BLOCK = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def floor_div(value: Column, size) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.floor(value / size).cast("int")


def offsets_array(offsets) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in offsets])


def spread(cells: DataFrame, offsets, *keep: str) -> DataFrame:
    """Every cell once per offset, moved to the neighbour: (row, col, di, dj, *keep)."""
    moved = cells.select(*keep, "row", "col", F.explode(offsets_array(offsets)).alias("o"))
    return moved.select(
        (F.col("row") + F.col("o.di")).alias("row"), (F.col("col") + F.col("o.dj")).alias("col"),
        F.col("o.di").alias("di"), F.col("o.dj").alias("dj"), *keep,
    )


def inside(height: int, width: int) -> Column:
    return F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)


def cell_key(row: Column, col: Column) -> Column:
    """One BIGINT per cell that orders cells in raster order (col below 2**31)."""
    return F.shiftleft(row.cast("bigint"), 32) + col.cast("bigint")


def segment_of(row: Column, col: Column, segment_h, segment_w) -> list[Column]:
    return [floor_div(row, segment_h).alias("seg_row"), floor_div(col, segment_w).alias("seg_col")]


def cell_coordinates(row: Column, col: Column, origin_x: Column, origin_y: Column, density: Column) -> list[Column]:
    """Map position of a cell; row 0 is the northern edge."""
    return [(origin_x + col * density).alias("map_x"), (origin_y - row * density).alias("map_y")]


def covering_tiles(cells: DataFrame, tile_h: int, tile_w: int, halo: int) -> DataFrame:
    """Each cell once per tile whose core grown by ``halo`` covers it (adds tile_row, tile_col)."""

    def span(position, size):
        return F.sequence(floor_div(position - halo, size), floor_div(position + halo, size))

    return (
        cells.withColumn("tile_row", F.explode(span(F.col("row"), tile_h)))
        .withColumn("tile_col", F.explode(span(F.col("col"), tile_w)))
    )
