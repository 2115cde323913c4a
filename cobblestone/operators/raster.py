"""City rasters: rasterising streets, tiles, windows, overlays, enrichment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.functions import geodesy, lattice, planar
from cobblestone.functions.lattice import CHANNELS

# --- rasterising ------------------------------------------------------------------


def street_pieces(edges: DataFrame, *keep: str) -> DataFrame:
    """Straight pieces of every street with the half-width offset (nx, ny) of their rectangle."""
    piece = edges.where(F.col("width_m").isNotNull()).select(
        *keep, "width_m", F.explode(planar.pieces(F.col("geometry"))).alias("s")
    )
    flat = piece.select(
        *keep, "width_m", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"),
        F.col("s.b.y").alias("y2"),
    )
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    half = F.col("width_m") / 2 / F.sqrt(dx * dx + dy * dy)
    return flat.select(*keep, "x1", "y1", "x2", "y2", (dy * half).alias("nx"), (-dx * half).alias("ny"))


def piece_bounds(pieces: DataFrame, *by: str) -> DataFrame:
    """Total bounds of the street polygons (A1), one row; a row per value of ``by`` if given."""
    wx, wy = F.abs("nx"), F.abs("ny")
    return pieces.groupBy(*by).agg(
        F.min(F.least("x1", "x2") - wx).alias("min_x"), F.min(F.least("y1", "y2") - wy).alias("min_y"),
        F.max(F.greatest("x1", "x2") + wx).alias("max_x"), F.max(F.greatest("y1", "y2") + wy).alias("max_y"),
    )


# An overlap thinner than this share of a cell is a mere touch of borders and sets nothing.
SLIVER = 1e-9


def _corners():
    x1, y1, x2, y2, nx, ny = (F.col(c) for c in ("x1", "y1", "x2", "y2", "nx", "ny"))
    return [(x1 + nx, y1 + ny), (x2 + nx, y2 + ny), (x2 - nx, y2 - ny), (x1 - nx, y1 - ny)]


def _touched(framed: DataFrame, density: float | Column, keys: tuple[str, ...], parts) -> DataFrame:
    """What ``parts`` makes of the run of columns that a street piece touches in a row (all-touched), a row each.

    ``density`` may be a column of the frame, so that frames of different density are one job.

    A frame is an origin (ox, oy: upper left), a clip box (cx0 .. cy1) and a shape
    (h, w). A rectangle is convex, so within one raster row it covers one run of
    columns: rows are exploded, the run follows in closed form, and the work is
    proportional to the cells set rather than to the bounding box.

    Few pieces make many cells, so pieces are spread over all shuffle partitions
    first. Empty runs leave through ``explode_outer`` and a null test: a filter on the
    run itself would be pushed down and its long expression computed twice.
    """
    spread = framed.repartition(int(framed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    corners = _corners()
    a = [(x - F.col("ox")) / density for x, _ in corners]
    b = [(F.col("oy") - y) / density for _, y in corners]
    placed = spread.select(*keys, "h", "w", *[
        c.alias(n) for i in range(4) for c, n in ((a[i], f"a{i}"), (b[i], f"b{i}"))
    ], *[((F.col("oy") - F.col(c)) / density).alias(n) for c, n in (("cy1", "_y0"), ("cy0", "_y1"))],
        *[((F.col(c) - F.col("ox")) / density).alias(n) for c, n in (("cx0", "_x0"), ("cx1", "_x1"))])

    # per side: height range and slope; a level side adds nothing its neighbours do not have
    def side(i):
        j = (i + 1) % 4
        return (
            F.least(f"b{i}", f"b{j}").alias(f"lo{i}"), F.greatest(f"b{i}", f"b{j}").alias(f"hi{i}"),
            ((F.col(f"a{j}") - F.col(f"a{i}")) / F.nullif(F.col(f"b{j}") - F.col(f"b{i}"), F.lit(0.0))).alias(f"m{i}"),
        )

    bs = [f"b{i}" for i in range(4)]
    sides = placed.select("*", *[c for i in range(4) for c in side(i)]).withColumns({
        "_top": F.greatest(F.least(*bs), F.col("_y0")), "_bottom": F.least(F.greatest(*bs), F.col("_y1")),
    })
    first = F.greatest(F.floor(F.col("_top") + SLIVER), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.col("_bottom") - SLIVER) - 1, F.col("h") - 1).cast("int")
    some = (F.col("_bottom") - F.col("_top") > SLIVER) & (first <= last)
    rows = sides.withColumn("row", F.explode_outer(F.when(some, F.sequence(first, last)))).where(F.col("row").isNotNull())
    low = F.greatest(F.col("row").cast("double"), F.col("_top"))
    high = F.least(F.col("row").cast("double") + 1, F.col("_bottom"))
    lows, highs = [], []
    for i in range(4):
        v0, v1 = F.greatest(F.col(f"lo{i}"), low), F.least(F.col(f"hi{i}"), high)
        u0, u1 = (F.col(f"a{i}") + F.col(f"m{i}") * (v - F.col(f"b{i}")) for v in (v0, v1))
        lows.append(F.when(v0 <= v1, F.least(u0, u1)))
        highs.append(F.when(v0 <= v1, F.greatest(u0, u1)))
    spans = rows.select(*keys, "row", "w", "_x0", "_x1", F.least(*lows).alias("_low"), F.greatest(*highs).alias("_high"))
    left, right = F.greatest("_low", "_x0"), F.least("_high", "_x1")
    c0 = F.greatest(F.floor(left + SLIVER), F.lit(0)).cast("int")
    c1 = F.least(F.ceil(right - SLIVER) - 1, F.col("w") - 1).cast("int")
    run = F.when(F.col("_low").isNotNull() & (right - left > SLIVER) & (c0 <= c1), parts(c0, c1))
    found = spans.select(*keys, "row", F.explode_outer(run).alias("col"))
    return found.where(F.col("col").isNotNull())


def touched_cells(framed: DataFrame, density: float | Column, *keys: str) -> DataFrame:
    """Every raster cell a street piece touches (all-touched), once per frame: (keys..., row, col)."""
    return _touched(framed, density, keys, F.sequence).distinct()


def touched_runs(framed: DataFrame, density: float | Column, *keys: str) -> DataFrame:
    """``touched_cells`` as the runs of columns that every piece covers, which may overlap: (keys..., row, first, last)."""
    runs = _touched(framed, density, keys, lambda first, last: F.array(F.struct(first.alias("first"), last.alias("last"))))
    return runs.select(*keys, "row", "col.first", "col.last")


def _whole_frame(density: float):
    """Frame over the total bounds: origin truncated to whole metres, no clipping."""
    return {
        "ox": F.col("min_x").cast("bigint").cast("double"), "oy": F.col("max_y").cast("bigint").cast("double"),
        "cx0": F.lit(-1e18), "cy0": F.lit(-1e18), "cx1": F.lit(1e18), "cy1": F.lit(1e18),
        "h": F.floor((F.col("max_y") - F.col("min_y")).cast("bigint") / density).cast("int"),
        "w": F.floor((F.col("max_x") - F.col("min_x")).cast("bigint") / density).cast("int"),
    }


def rasterise(pieces: DataFrame, density: float = 1.0) -> DataFrame:
    """Streets to the cells of one raster over their total bounds."""
    framed = pieces.join(F.broadcast(piece_bounds(pieces))).withColumns(_whole_frame(density))  # one row
    return touched_cells(framed, density)


def rasterise_window(pieces: DataFrame, min_x: float, max_x: float, min_y: float, max_y: float, density: float = 1.0) -> DataFrame:
    """Streets to the cells of a given window, cut to the total bounds."""
    wx, wy = F.abs("nx"), F.abs("ny")
    near = (F.greatest("x1", "x2") + wx >= min_x) & (F.least("x1", "x2") - wx <= max_x) & (
        F.greatest("y1", "y2") + wy >= min_y) & (F.least("y1", "y2") - wy <= max_y)
    bounds = piece_bounds(pieces).select(
        F.greatest("min_x", F.lit(min_x)).alias("min_x"), F.greatest("min_y", F.lit(min_y)).alias("min_y"),
        F.least("max_x", F.lit(max_x)).alias("max_x"), F.least("max_y", F.lit(max_y)).alias("max_y"),
    )
    frame = _whole_frame(density) | {c: F.col(b) for c, b in (("cx0", "min_x"), ("cy0", "min_y"), ("cx1", "max_x"), ("cy1", "max_y"))}
    return touched_cells(pieces.where(near).join(F.broadcast(bounds)).withColumns(frame), density)


def rasterise_segments(
    pieces: DataFrame, segment_h: int, segment_w: int, density: float = 1.0, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Streets to the cells of every segment in one job (R5): (seg_row, seg_col, row, col), row/col in the segment.

    Each segment has its own origin, truncated to whole metres, and only the part of
    a street inside the segment's box counts. ``keep`` names columns of the pieces that
    stay with their cells.
    """
    sizes = {"density": F.lit(float(density)), "segment_h": F.lit(segment_h), "segment_w": F.lit(segment_w)}
    joined = pieces.join(F.broadcast(piece_bounds(pieces).withColumns(sizes)))  # one row
    return touched_cells(_segment_frames(joined), F.col("density"), "seg_row", "seg_col", *keep)


def _segment_frames(joined: DataFrame) -> DataFrame:
    """Pieces with the bounds, density and segment size of their raster, once per segment they may touch, with its frame."""
    density = F.col("density")
    joined = joined.withColumns({
        "sw": F.least("segment_w", F.ceil((F.col("max_x") - F.col("min_x")) / density).cast("int")),
        "sh": F.least("segment_h", F.ceil((F.col("max_y") - F.col("min_y")) / density).cast("int")),
    })
    wx, wy = F.abs("nx"), F.abs("ny")

    def span(low, high, size, limit):
        top = F.ceil(limit / size).cast("int") - 1
        return F.sequence(
            F.greatest(F.least(F.floor(low / size).cast("int"), top), F.lit(0)),
            F.greatest(F.least(F.floor(high / size).cast("int"), top), F.lit(0)),
        )

    step_x, step_y = F.col("sw") * density, F.col("sh") * density
    tiles = joined.withColumn(
        "seg_col", F.explode(span(
            F.least("x1", "x2") - wx - F.col("min_x"), F.greatest("x1", "x2") + wx - F.col("min_x"), step_x,
            F.col("max_x") - F.col("min_x"))),
    ).withColumn(
        "seg_row", F.explode(span(
            F.col("max_y") - F.greatest("y1", "y2") - wy, F.col("max_y") - F.least("y1", "y2") + wy, step_y,
            F.col("max_y") - F.col("min_y"))),
    )
    return tiles.withColumns({
        "cx0": F.col("min_x") + F.col("seg_col") * step_x, "cy1": F.col("max_y") - F.col("seg_row") * step_y,
    }).withColumns({
        "cx1": F.least(F.col("cx0") + step_x, F.col("max_x")), "cy0": F.greatest(F.col("cy1") - step_y, F.col("min_y")),
    }).withColumns({
        "ox": F.col("cx0").cast("bigint").cast("double"), "oy": F.col("cy1").cast("bigint").cast("double"),
        "w": F.ceil((F.col("cx1") - F.col("cx0")) / density).cast("int"),
        "h": F.ceil((F.col("cy1") - F.col("cy0")) / density).cast("int"),
    })


# --- tiles and cells --------------------------------------------------------------


def dense_tiles(cells: DataFrame, rows: int, cols: int, segment_h: int, segment_w: int, channels=CHANNELS) -> DataFrame:
    """Sparse cells to dense row-major tiles with interleaved channels (R2); absent cells are 0.

    One group is one tile of fixed size. Segments without any cell come from the
    segment lattice, filled with zeros.
    """
    n = len(channels)
    spark = cells.sparkSession
    seg_rows, seg_cols = -(-rows // segment_h), -(-cols // segment_w)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        seg_row, seg_col = int(pdf["seg_row"].iloc[0]), int(pdf["seg_col"].iloc[0])
        h, w = min(segment_h, rows - seg_row * segment_h), min(segment_w, cols - seg_col * segment_w)
        data = np.zeros((h, w, n), dtype=np.float32)
        data[pdf["row"] - seg_row * segment_h, pdf["col"] - seg_col * segment_w] = pdf[list(channels)].to_numpy("float32")
        return pd.DataFrame({"seg_row": [seg_row], "seg_col": [seg_col], "h": [h], "w": [w], "channels": [n], "data": [data.ravel()]})

    keyed = cells.select("row", "col", *channels, *lattice.segment_of(F.col("row"), F.col("col"), segment_h, segment_w))
    full = keyed.groupBy("seg_row", "seg_col").applyInPandas(
        fill, "seg_row int, seg_col int, h int, w int, channels int, data array<float>"
    )
    every = spark.range(seg_rows * seg_cols).select(
        F.floor(F.col("id") / seg_cols).cast("int").alias("seg_row"), (F.col("id") % seg_cols).cast("int").alias("seg_col")
    )
    joined = every.join(full, ["seg_row", "seg_col"], "left")
    h = F.least(F.lit(segment_h), F.lit(rows) - F.col("seg_row") * segment_h)
    w = F.least(F.lit(segment_w), F.lit(cols) - F.col("seg_col") * segment_w)
    return joined.select(
        "seg_row", "seg_col", h.alias("h"), w.alias("w"), F.lit(n).alias("channels"),
        F.coalesce("data", F.array_repeat(F.lit(0.0).cast("float"), h * w * n)).alias("data"),
    )


def tile_cells(tiles: DataFrame, segment_h: int, segment_w: int, channels=CHANNELS, sparse: bool = True) -> DataFrame:
    """Dense tiles to cells (R1); ``sparse`` leaves out cells whose channels are all 0."""
    n = len(channels)
    at = tiles.select("seg_row", "seg_col", "w", "data", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("i"))
    cells = at.select(
        (F.col("seg_row") * segment_h + F.floor(F.col("i") / F.col("w")).cast("int")).alias("row"),
        (F.col("seg_col") * segment_w + F.col("i") % F.col("w")).alias("col"),
        *[F.get("data", F.col("i") * n + k).alias(c) for k, c in enumerate(channels)],
    )
    if sparse:
        set_any = F.lit(False)
        for c in channels:
            set_any = set_any | (F.col(c) != 0)
        cells = cells.where(set_any)
    return cells


def resegment(tiles: DataFrame, rows: int, cols: int, old: tuple[int, int], new: tuple[int, int], channels=CHANNELS) -> DataFrame:
    """The same grid in tiles of another size."""
    return dense_tiles(tile_cells(tiles, *old, channels), rows, cols, *new, channels)


# --- windows and overlays ---------------------------------------------------------


def read_window(cells: DataFrame, row: int, col: int, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """An arbitrary rectangle, indices from its own corner (F4); it must lie inside the grid."""
    if row < 0 or col < 0 or row + height > rows or col + width > cols:
        raise ValueError(f"window {row},{col} {height}x{width} exceeds the grid {rows}x{cols}")
    kept = cells.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))
    return kept.withColumn("row", F.col("row") - row).withColumn("col", F.col("col") - col)


def overlay(cells: DataFrame, fragment: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """Writes a fragment over a rectangle of a grid (J12): inside the rectangle only the fragment counts.

    The rectangle is known, so nothing needs to be matched cell by cell: what lies
    outside of it passes through and the fragment is appended, without a shuffle.
    """
    outside = ~(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))
    moved = fragment.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).withColumn(
        "row", F.col("row") + row).withColumn("col", F.col("col") + col)
    return cells.where(outside).unionByName(moved.select(*cells.columns))


def upsert(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Cell-by-cell overlay (J12): the update wins where it has a cell."""
    old = [c for c in cells.columns if c not in ("row", "col")]
    new = updates.select("row", "col", F.struct(*old).alias("_new"))
    joined = cells.select("row", "col", F.struct(*old).alias("_old")).join(new, ["row", "col"], "full")
    return joined.select("row", "col", F.coalesce("_new", "_old").alias("_v")).select("row", "col", "_v.*")


def cut_start(start: Column, other: Column, size: Column, other_size: Column, surplus: Column, extent: Column, clip_index: bool) -> Column:
    """Where a cut starts along one axis, its surplus reduced near the border and the end kept inside."""
    used = F.greatest(F.least(surplus, start, other, size, other_size), F.lit(0))
    moved = start * (size - used) - used / 2 if clip_index else start - used / 2
    return F.least(moved.cast("int"), extent - size)


def cut_windows(requests: DataFrame, rows: int, cols: int, clip_index: bool) -> DataFrame:
    """Cut requests (cut_id, x, y, h, w, surplus) to rectangles (cut_id, y0, x0, h, w)."""
    x, y, h, w, s = (F.col(c) for c in ("x", "y", "h", "w", "surplus"))
    return requests.select(
        "cut_id", cut_start(y, x, h, w, s, F.lit(rows), clip_index).alias("y0"),
        cut_start(x, y, w, h, s, F.lit(cols), clip_index).alias("x0"), "h", "w",
    )


def cut_cells(windows: DataFrame, cells: DataFrame, block: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of many windows in one job (J6): windows go to the blocks they cover, then an equi-join.

    Result: (cut_id, *keep, row, col, channels...), row/col from the window's corner.
    """
    covered = windows.withColumn(
        "br", F.explode(F.sequence(lattice.floor_div(F.col("y0"), block), lattice.floor_div(F.col("y0") + F.col("h") - 1, block)))
    ).withColumn(
        "bc", F.explode(F.sequence(lattice.floor_div(F.col("x0"), block), lattice.floor_div(F.col("x0") + F.col("w") - 1, block)))
    )
    keyed = cells.withColumn("br", lattice.floor_div(F.col("row"), block)).withColumn("bc", lattice.floor_div(F.col("col"), block))
    inside = (
        (F.col("row") >= F.col("y0")) & (F.col("row") < F.col("y0") + F.col("h"))
        & (F.col("col") >= F.col("x0")) & (F.col("col") < F.col("x0") + F.col("w"))
    )
    values = [c for c in cells.columns if c not in ("row", "col")]
    return covered.join(keyed, ["br", "bc"]).where(inside).select(
        "cut_id", *keep, (F.col("row") - F.col("y0")).alias("row"), (F.col("col") - F.col("x0")).alias("col"), *values
    )


def halo_tiles(cells: DataFrame, height: int, width: int, tile_h: int, tile_w: int, halo: int = 10) -> DataFrame:
    """Cells once per tile of the raster whose core plus halo covers them, tiles without street left out."""
    inside = F.col("tile_row").between(0, (height - 1) // tile_h) & F.col("tile_col").between(0, (width - 1) // tile_w)
    spread = lattice.covering_tiles(cells, tile_h, tile_w, halo).where(inside)
    live = spread.groupBy("tile_row", "tile_col").agg(F.max("is_street").alias("_s")).where(F.col("_s") > 0).drop("_s")
    return spread.join(live, ["tile_row", "tile_col"], "left_semi")


# --- channels and enrichment ------------------------------------------------------


def threshold(cells: DataFrame, *channels: str) -> DataFrame:
    """Probabilities to 0/1 above one half."""
    return cells.withColumns({c: (F.col(c) > 0.5).cast("double") for c in channels})


def fill_channel(cells: DataFrame, channel: str, value: float = 0.0) -> DataFrame:
    """One channel set to a constant (P16); also gives a bare mask its missing channels."""
    return cells.withColumn(channel, F.lit(float(value)))


def elevation_of(points: DataFrame, elevation: DataFrame, y: str, x: str, step_y: float, step_x: float) -> DataFrame:
    """Elevation at (y, x) from a lattice table (iy, ix, elevation); 0.0 where there is none."""
    keyed = points.withColumn("iy", F.floor(F.col(y) / step_y).cast("int")).withColumn("ix", F.floor(F.col(x) / step_x).cast("int"))
    joined = keyed.join(elevation.select("iy", "ix", "elevation"), ["iy", "ix"], "left")
    return joined.withColumn("elevation", F.coalesce("elevation", F.lit(0.0))).drop("iy", "ix")


def add_elevation(
    cells: DataFrame, elevation: DataFrame, origin_x: float, origin_y: float, density: float, step: float,
    epsg: int | None = None,
) -> DataFrame:
    """Altitude channel from an elevation lattice in degrees.

    The grid's EPSG code says how to get to degrees. Without one, an origin in the
    range of degrees is taken as such and any other as UTM zone 34 north.
    """
    metric = epsg is not None or not -180 <= origin_x <= 180
    x, y = lattice.cell_coordinates(F.col("row"), F.col("col"), F.lit(origin_x), F.lit(origin_y), F.lit(density))
    placed = cells.withColumns({"_x": x, "_y": y})
    if metric:
        p = geodesy.to_geographic(F.col("_x"), F.col("_y"), F.lit(epsg or 32634))
        placed = placed.withColumn("_p", p).withColumns({"_x": F.col("_p.x"), "_y": F.col("_p.y")}).drop("_p")
    found = elevation_of(placed, elevation, "_y", "_x", step, step)
    return found.withColumn("altitude", F.col("elevation")).drop("_x", "_y", "elevation")


def add_residential(cells: DataFrame, residential: DataFrame) -> DataFrame:
    """Residential channel overwritten from rasterised residential streets.

    A residential cell without a grid cell becomes one, as the channel is written for the whole raster.
    """
    marks = residential.select("row", "col").distinct().withColumn("_res", F.lit(1.0))
    joined = cells.drop("is_residential").join(marks, ["row", "col"], "full")
    others = [c for c in cells.columns if c not in ("row", "col", "is_residential")]
    return joined.select(
        "row", "col", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in others],
        F.coalesce("_res", F.lit(0.0)).alias("is_residential"),
    ).select(*cells.columns)


def segment_ranges(cells: DataFrame, segment_h: int, segment_w: int, channels=CHANNELS) -> DataFrame:
    """Smallest and largest value of every channel per segment."""
    keyed = cells.select(*lattice.segment_of(F.col("row"), F.col("col"), segment_h, segment_w), *channels)
    aggs = [f(c).alias(f"{name}_{c}") for c in channels for name, f in (("min", F.min), ("max", F.max))]
    return keyed.groupBy("seg_row", "seg_col").agg(*aggs)
