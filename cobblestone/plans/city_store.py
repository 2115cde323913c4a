"""Streets of many cities to a store of enriched rasters (R3, R5 to R8, S4) in one plan.

``<store>/grids`` is the table of the rasters (``grids.describe``), ``<store>/tiles`` their dense tiles in one folder per city.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cobblestone.operators import grids, raster
from cobblestone.session import cut_lineage
from cobblestone.sources import grid_meta
from cobblestone.sources.tiles import TILE_FILES


def city_tiles(roads: DataFrame, requests: DataFrame, elevation: DataFrame, step: float):
    """(meta, tiles) of every requested city.

    ``roads`` is (city, geometry, width_m, is_residential), in metres of the city's projection; ``requests`` is (city, density,
    segment_h, segment_w, epsg); ``elevation`` (iy, ix, elevation) has a place every ``step`` degrees.
    """
    pieces = cut_lineage(raster.street_pieces(roads, "city", "is_residential"), "pieces")
    bounds = cut_lineage(raster.piece_bounds(pieces, "city"), "bounds")
    meta = cut_lineage(grids.describe(bounds, requests), "grids")
    cells = grids.rasterise(pieces, bounds, requests, runs=True)
    return meta, grids.dense_tiles(cells, meta, grids.elevation_tiles(meta, elevation, step))


def write_store(meta: DataFrame, tiles: DataFrame, store: str) -> None:
    """Writes the rasters; a city that is there already is replaced, others stay."""
    for df, name, options in ((tiles.repartition("city", "seg_row"), "tiles", TILE_FILES), (meta, "grids", {})):
        df.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy("city").parquet(f"{store}/{name}")


def read_store(spark: SparkSession, store: str, city: str | None = None):
    """(meta, tiles), of one city if named: only its folders are read. Tiles that do not fit their raster are an error."""
    meta, tiles = (spark.read.schema(s).parquet(f"{store}/{n}") for n, s in (("grids", META), ("tiles", grids.TILE)))
    if city is not None:
        meta, tiles = meta.where(meta.city == city), tiles.where(tiles.city == city)
    grid_meta.assert_tiles_fit(tiles.select(*grids.KEYS, "h", "w"), meta, "city")
    return meta, tiles


META = (
    "city string, rows int, cols int, origin_x double, origin_y double, density double, segment_h int, segment_w int, epsg int"
)
