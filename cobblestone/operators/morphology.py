"""Morphology on sparse street cells: a cell that is absent is 0."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cobblestone.functions import lattice
from cobblestone.operators import components
from cobblestone.session import cut_lineage

# Smallest kept object, padding of the thinned raster.
MIN_OBJECT = 10
THINNING_PAD = 5
# The eight neighbours clockwise from the one above; bit i of a ring mask is neighbour i.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def remove_small_objects(cells: DataFrame, min_size: int = MIN_OBJECT, tile: int = 256) -> DataFrame:
    """Drops 4-connected objects of fewer than ``min_size`` cells.

    An object that small reaches fewer than ``min_size`` cells from any of its cells, so
    a tile with a halo of that width decides exactly for its core: one shuffle, no
    labelling of the whole raster.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        rows, cols = pdf["row"].to_numpy("int64"), pdf["col"].to_numpy("int64")
        root = components.group_labels(len(pdf), *components.neighbour_links(rows, cols, lattice.ORTHOGONAL))
        large = np.bincount(root, minlength=len(pdf))[root] >= min_size
        core = (rows // tile == pdf["tile_row"].iloc[0]) & (cols // tile == pdf["tile_col"].iloc[0])
        return pdf.loc[large & core, ["row", "col"]]

    tiled = lattice.covering_tiles(cells.select("row", "col"), tile, tile, min_size)
    return tiled.groupBy("tile_row", "tile_col").applyInPandas(keep, "row int, col int")


def dilate_cross(cells: DataFrame, height: int, width: int) -> DataFrame:
    moved = lattice.spread(cells.select("row", "col"), lattice.CROSS)
    return moved.where(lattice.inside(height, width)).select("row", "col").distinct()


def erode_cross(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Cells whose whole cross inside the raster is set; cells outside the raster do not count."""
    votes = lattice.spread(cells.select("row", "col"), lattice.CROSS).where(lattice.inside(height, width))
    outside = (
        (F.col("row") == 0).cast("int") + (F.col("row") == height - 1).cast("int")
        + (F.col("col") == 0).cast("int") + (F.col("col") == width - 1).cast("int")
    )
    counted = votes.groupBy("row", "col").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") == F.lit(len(lattice.CROSS)) - outside).select("row", "col")


def close_cross(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Binary closing with a disk of radius one."""
    return erode_cross(dilate_cross(cells, height, width), height, width)


def dilate_square(cells: DataFrame, height: int, width: int, times: int) -> DataFrame:
    """Dilation by a 3 x 3 square repeated ``times`` (R12): rows first, then columns."""
    steps = range(-times, times + 1)
    tall = lattice.spread(cells.select("row", "col"), [(i, 0) for i in steps]).select("row", "col").distinct()
    wide = lattice.spread(tall, [(0, j) for j in steps]).select("row", "col")
    return wide.where(lattice.inside(height, width)).distinct()


def clean_tiles(cells: DataFrame, height: int, width: int, min_size: int = MIN_OBJECT, tile: int = 256) -> DataFrame:
    """``remove_small_objects`` and ``close_cross`` of the cells with ``is_street`` > 0, with altitude, in one shuffle.

    ``cells`` is (row, col, is_street, altitude); the result (row, col, altitude), 0.0 where the raster has no altitude. A closed
    cell depends on objects that come within two cells of it, so a halo of ``min_size`` + 2 decides exactly.
    """
    halo = min_size + 2

    def run(table: pa.Table) -> pa.Table:
        tile_row, tile_col = table["tile_row"][0].as_py(), table["tile_col"][0].as_py()
        top, left = tile_row * tile - halo, tile_col * tile - halo
        row, col = table["row"].to_numpy() - top, table["col"].to_numpy() - left
        image = np.zeros((tile + 2 * halo, tile + 2 * halo), dtype=bool)
        ground = np.zeros(image.shape)
        ground[row, col] = table["altitude"].to_numpy(zero_copy_only=False)
        street = table["street"].to_numpy(zero_copy_only=False).astype(bool)
        image[row[street], col[street]] = True
        rows, cols = np.nonzero(image)
        if len(rows):
            root = components.group_labels(len(rows), *components.neighbour_links(rows, cols, lattice.ORTHOGONAL))
            small = np.bincount(root, minlength=len(rows))[root] < min_size
            image[rows[small], cols[small]] = False
        i, j = np.arange(top, top + len(image))[:, None], np.arange(left, left + len(image))[None, :]
        inside = (i >= 0) & (i < height) & (j >= 0) & (j < width)
        grown = image.copy()
        grown[1:-1, 1:-1] = np.logical_or.reduce([image[1 + a : len(image) - 1 + a, 1 + b : len(image) - 1 + b] for a, b in lattice.CROSS])
        solid = grown | ~inside  # cells outside the raster do not count
        core = slice(halo, halo + tile)
        closed = np.logical_and.reduce([solid[halo + a : halo + a + tile, halo + b : halo + b + tile] for a, b in lattice.CROSS]) & inside[core, core]
        rows, cols = np.nonzero(closed)
        return pa.table({
            "row": pa.array((rows + top + halo).astype(np.int32)), "col": pa.array((cols + left + halo).astype(np.int32)),
            "altitude": pa.array(ground[rows + halo, cols + halo])})

    plain = cells.select(
        F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce(F.col("altitude").cast("double"), F.lit(0.0)).alias("altitude"),
        F.coalesce(F.col("is_street") > 0, F.lit(False)).alias("street"))
    tiled = lattice.covering_tiles(plain, tile, tile, halo)
    return tiled.groupBy("tile_row", "tile_col").applyInArrow(run, "row int, col int, altitude double")


def tile_images(cells: DataFrame, tile: int, halo: int, solve: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """Cells (row, col) that ``solve`` sets in each square tile; one shuffle of the cells, and a task holds one tile.

    ``solve`` gets the tile with ``halo`` cells around it as a boolean array and the position of the tile's corner, and
    returns the array of the tile alone.
    """

    def run(table: pa.Table) -> pa.Table:
        top, left = table["tile_row"][0].as_py() * tile, table["tile_col"][0].as_py() * tile
        image = np.zeros((tile + 2 * halo, tile + 2 * halo), dtype=bool)
        image[table["row"].to_numpy() - (top - halo), table["col"].to_numpy() - (left - halo)] = True
        rows, cols = np.nonzero(solve(image, top, left))
        return pa.table({"row": pa.array((rows + top).astype(np.int32)), "col": pa.array((cols + left).astype(np.int32))})

    plain = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    return lattice.covering_tiles(plain, tile, tile, halo).groupBy("tile_row", "tile_col").applyInArrow(run, "row int, col int")


def border_cells(cells: DataFrame, height: int, width: int, tile: int = 256) -> DataFrame:
    """Street cells with a non-street cell in their 3 x 3 neighbourhood inside the raster."""

    def border(image: np.ndarray, top: int, left: int) -> np.ndarray:
        row, col = np.arange(top - 1, top + tile + 1)[:, None], np.arange(left - 1, left + tile + 1)[None, :]
        full = image | (row < 0) | (row >= height) | (col < 0) | (col >= width)  # what lies outside the raster does not count
        tall = full[:-2] & full[1:-1] & full[2:]
        return image[1:-1, 1:-1] & ~(tall[:, :-2] & tall[:, 1:-1] & tall[:, 2:])

    return tile_images(cells, tile, 1, border)


def border_components(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Street borders: components of border cells."""
    return components.label_cells(border_cells(cells, height, width))


def touching_tile_edge(cells: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """Cohesive runs of street cells along tile edges (R17): edge cells with the label of their run."""
    r, c = F.pmod(F.col("row"), F.lit(tile_h)), F.pmod(F.col("col"), F.lit(tile_w))
    edge = cells.where(r.isin(0, tile_h - 1) | c.isin(0, tile_w - 1)).select(
        "row", "col", lattice.floor_div(F.col("row"), tile_h).alias("tile_row"),
        lattice.floor_div(F.col("col"), tile_w).alias("tile_col"),
    )
    return components.label_within(edge, ["tile_row", "tile_col"])


def ring_masks(cells: DataFrame) -> DataFrame:
    """8-bit neighbour mask of every position that has a neighbour: (row, col, mask)."""
    seen = F.array(*[
        F.struct(F.lit(-i).alias("di"), F.lit(-j).alias("dj"), F.lit(1 << bit).alias("bit")) for bit, (i, j) in enumerate(RING)
    ])
    votes = cells.select("row", "col", F.explode(seen).alias("o")).select(
        (F.col("row") + F.col("o.di")).alias("row"), (F.col("col") + F.col("o.dj")).alias("col"), F.col("o.bit").alias("bit")
    )
    return votes.groupBy("row", "col").agg(F.bit_or("bit").alias("mask"))


def crossroad_cells(skeleton: DataFrame, height: int, width: int) -> DataFrame:
    """3 x 3 blocks around positions whose ring has three or more separate runs of ones."""
    turned = F.shiftleft("mask", 1).bitwiseOR(F.shiftright("mask", 7)).bitwiseAND(F.lit(255))
    runs = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(turned)))
    inner = F.col("row").between(1, height - 2) & F.col("col").between(1, width - 2)
    centres = ring_masks(skeleton).where(inner & (runs >= 3)).select("row", "col")
    return lattice.spread(centres, lattice.BLOCK).select("row", "col").distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of ``a`` that are also in ``b``."""
    return a.join(b.select("row", "col"), ["row", "col"], "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of ``a`` that are not in ``b``."""
    return a.join(b.select("row", "col"), ["row", "col"], "left_anti")


# --- thinning ---------------------------------------------------------------------

def _thinned(second: bool) -> np.ndarray:
    """Whether a sub-iteration of Zhang and Suen (1984) deletes a cell, by the mask of its ring."""
    ring = (np.arange(256)[:, None] >> np.arange(8)) & 1 == 1
    total = ring.sum(axis=1)
    runs = (~ring & np.roll(ring, -1, axis=1)).sum(axis=1)
    north, east, south, west = ring[:, 0], ring[:, 2], ring[:, 4], ring[:, 6]
    if second:
        keep = (north & east & west) | (north & south & west)
    else:
        keep = (north & east & south) | (east & south & west)
    return (total >= 2) & (total <= 6) & (runs == 1) & ~keep


_THINNED = (_thinned(False), _thinned(True))


def thin_once(image: np.ndarray, second: bool) -> np.ndarray:
    """One sub-iteration on a boolean array with a rim of spare cells."""
    h, w = image.shape[0] - 2, image.shape[1] - 2
    bits = image.view(np.uint8)
    mask = np.zeros((h, w), np.uint8)
    for bit, (i, j) in enumerate(RING):
        mask |= bits[1 + i : 1 + i + h, 1 + j : 1 + j + w] << bit
    out = image.copy()
    out[1:-1, 1:-1] &= ~_THINNED[second][mask]
    return out


def frame_cells(spark, height: int, width: int, pad: int = THINNING_PAD) -> DataFrame:
    """The padding of a raster: all cells at most ``pad`` outside it."""
    rows = spark.range(-pad, height + pad).select(F.col("id").cast("int").alias("row"))
    inside_row = F.col("row").between(0, height - 1)
    columns = F.when(
        inside_row,
        F.concat(F.sequence(F.lit(-pad), F.lit(-1)), F.sequence(F.lit(width), F.lit(width + pad - 1))),
    ).otherwise(F.sequence(F.lit(-pad), F.lit(width + pad - 1)))
    return rows.select("row", F.explode(columns).alias("col"))


def _thin_tiles(cells: DataFrame, tile: int, passes: int, first: int) -> DataFrame:
    """``passes`` sub-iterations on every tile grown by ``passes`` cells, which makes its core exact."""

    def thin(table: pa.Table) -> pa.Table:
        top, left = table["tile_row"][0].as_py() * tile, table["tile_col"][0].as_py() * tile
        rim = passes + 1
        image = np.zeros((tile + 2 * rim, tile + 2 * rim), dtype=bool)
        image[table["row"].to_numpy() - top + rim, table["col"].to_numpy() - left + rim] = True
        before = image[rim:-rim, rim:-rim].copy()
        idle = 0
        for k in range(passes):
            thinner = thin_once(image, second=(first + k) % 2 == 1)
            idle = idle + 1 if np.array_equal(thinner, image) else 0
            image = thinner
            if idle == 2:  # neither kind of sub-iteration finds anything any more
                break
        core = image[rim:-rim, rim:-rim]
        rows, cols = np.nonzero(core)
        deleted = pa.array(np.full(max(len(rows), 1), (before & ~core).sum(), np.int64))
        if not len(rows):  # a tile thinned away still reports its deletions
            return pa.table({"row": pa.array([None], pa.int32()), "col": pa.array([None], pa.int32()), "deleted": deleted})
        return pa.table({"row": pa.array((rows + top).astype(np.int32)), "col": pa.array((cols + left).astype(np.int32)), "deleted": deleted})

    tiled = lattice.covering_tiles(cells.select("row", "col"), tile, tile, passes)
    return tiled.groupBy("tile_row", "tile_col").applyInArrow(thin, "row int, col int, deleted bigint")


def skeletonise(
    cells: DataFrame, height: int, width: int, tile: int = 256, passes: int = 8, total_passes: int | None = None
) -> DataFrame:
    """Thins a street mask to lines one cell wide.

    The raster is framed by set cells, so that streets leaving it reach its rim. Each
    round ships every tile with a halo once and runs ``passes`` sub-iterations on it,
    so the whole thinning of a street takes a few shuffles. Rounds go on until nothing
    is deleted, or until ``total_passes`` sub-iterations are done.
    """
    frame = frame_cells(cells.sparkSession, height, width)
    image = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).union(frame)
    done = 0
    while total_passes is None or done < total_passes:
        step = passes if total_passes is None else min(passes, total_passes - done)
        thinned = cut_lineage(_thin_tiles(image, tile, step, done), "thinning")
        done += step
        image = thinned.where(F.col("row").isNotNull()).select("row", "col")
        if total_passes is None and thinned.agg(F.coalesce(F.max("deleted"), F.lit(0))).first()[0] == 0:
            break
    return image.where(lattice.inside(height, width))
