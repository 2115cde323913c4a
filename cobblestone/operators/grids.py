"""Rasters of many cities in one plan: size, place, density and projection of every raster come from a table.

``meta`` is (city, rows, cols, origin_x, origin_y, density, segment_h, segment_w, epsg), a row per city; row 0 is the northern
edge. A task holds a segment of one city, whatever the number of cities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cobblestone.functions import geodesy
from cobblestone.operators import raster
from cobblestone.session import cut_lineage
from cobblestone.sources import grid_meta

KEYS = ["city", "seg_row", "seg_col"]
CHANNELS = 3  # is_street, altitude, is_residential
#: Assumed for grids in metres that do not name their projection.
DEFAULT_EPSG = 32634
_ROWS_AT_ONCE = 256
_KNOT = 16
TILE = "city string, seg_row int, seg_col int, h int, w int, channels int, data array<float>"


def values_of(arrays: pa.Array) -> list[np.ndarray]:
    """The arrays of a column, without a Python object per value."""
    ends, flat = arrays.offsets.to_numpy(), arrays.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def describe(bounds: DataFrame, requests: DataFrame) -> DataFrame:
    """``meta`` from the bounds of every city's streets and what was asked for: (city, density, segment_h, segment_w, epsg)."""
    sized = bounds.join(requests, "city")
    return sized.select(
        "city", F.ceil((F.col("max_y") - F.col("min_y")) / F.col("density")).cast("int").alias("rows"),
        F.ceil((F.col("max_x") - F.col("min_x")) / F.col("density")).cast("int").alias("cols"),
        F.col("min_x").alias("origin_x"), F.col("max_y").alias("origin_y"), "density", "segment_h", "segment_w", "epsg")


def rasterise(pieces: DataFrame, bounds: DataFrame, requests: DataFrame, runs: bool = False) -> DataFrame:
    """Streets of all cities to cells (city, row, col, is_residential).

    ``runs`` gives runs of cells of a row, which may overlap, with the column ``last``: for a target that takes a cell twice.

    ``pieces`` are those of ``raster.street_pieces`` with city and is_residential. Every segment has its own origin, truncated
    to whole metres, as in ``raster.rasterise_segments``.
    """
    framed = raster._segment_frames(pieces.join(bounds.join(requests, "city"), "city"))
    keys = ["city", "seg_row", "seg_col", "sh", "sw", "is_residential"]
    if runs:
        touched, from_col = raster.touched_runs(framed, F.col("density"), *keys), F.col("seg_col") * F.col("sw")
        return touched.select(
            "city", (F.col("seg_row") * F.col("sh") + F.col("row")).alias("row"), (from_col + F.col("first")).alias("col"),
            (from_col + F.col("last")).alias("last"), F.col("is_residential").cast("double").alias("is_residential"))
    touched = raster.touched_cells(framed, F.col("density"), *keys)
    row, col = F.col("seg_row") * F.col("sh") + F.col("row"), F.col("seg_col") * F.col("sw") + F.col("col")
    return touched.groupBy("city", row.alias("row"), col.alias("col")).agg(F.max(F.col("is_residential").cast("double")).alias("is_residential"))


def segments(meta: DataFrame) -> DataFrame:
    """Every segment of every city with its shape: ``meta`` and (seg_row, seg_col, expected_h, expected_w)."""
    def numbers(total: str, size: str):
        return F.explode(F.sequence(F.lit(0), F.ceil(F.col(total) / F.col(size)).cast("int") - 1))

    every = meta.where("rows > 0 and cols > 0").withColumn("seg_row", numbers("rows", "segment_h")).withColumn("seg_col", numbers("cols", "segment_w"))
    return grid_meta.with_expected_shape(every)


def _steps(seg: dict, row: np.ndarray, col: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of cells of a segment in steps of the elevation lattice; ``row`` and ``col`` are of one shape."""
    metric = seg["epsg"] is not None or not -180 <= seg["origin_x"] <= 180
    col, row = seg["seg_col"] * seg["segment_w"] + col, seg["seg_row"] * seg["segment_h"] + row
    x, y = seg["origin_x"] + col * seg["density"], seg["origin_y"] - row * seg["density"]
    if metric:
        x, y = geodesy.degrees_of(x, y, seg["epsg"] or DEFAULT_EPSG)
    return y / step, x / step


def _places(seg: dict, row: np.ndarray, col: np.ndarray, step: float) -> np.ndarray:
    """Places in the elevation lattice of rows and columns of a segment, as ``(iy << 32) + ix``."""
    y, x = _steps(seg, *np.meshgrid(row, col, indexing="ij"), step)
    return (np.floor(y).astype(np.int64) << 32) + np.floor(x).astype(np.int64)


def _indices(seg: dict, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(iy, ix) of all cells of a segment.

    The projection is computed for every ``_KNOT``-th row and column and interpolated between them. How far that is off
    along a row or a column shows in the middle between two knots; cells that are not clear of a line of the lattice by twice the
    sum of both are computed themselves, so that all get the place that computing every cell would give.
    """
    h, w = seg["expected_h"], seg["expected_w"]
    row, col = np.arange(0, h + _KNOT, _KNOT), np.arange(0, w + _KNOT, _KNOT)
    at = lambda r, c: _steps(seg, *np.meshgrid(r, c, indexing="ij"), step)
    knots, across, along = at(row, col), at(row, col[:-1] + _KNOT / 2), at(row[:-1] + _KNOT / 2, col)
    part = np.arange(_KNOT) / _KNOT
    out, near = [], np.zeros((h, w), bool)
    for knot, middle_of_row, middle_of_col in zip(knots, across, along):
        off = np.abs((knot[:, :-1] + knot[:, 1:]) / 2 - middle_of_row).max() + np.abs((knot[:-1] + knot[1:]) / 2 - middle_of_col).max()
        off = 2 * off + 1e-7
        down = (knot[:-1, None] * (1 - part[:, None]) + knot[1:, None] * part[:, None]).reshape(-1, len(col))[:h]
        value = (down[:, :-1, None] * (1 - part) + down[:, 1:, None] * part).reshape(h, -1)[:, :w]
        low = np.floor(value)
        value -= low
        near |= (value < off) | (value > 1 - off)
        out.append(low.astype(np.int64))
    row, col = np.nonzero(near)
    for index, exact in zip(out, _steps(seg, row, col, step)):
        index[row, col] = np.floor(exact)
    return out[0], out[1]


def _apart(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(iy, ix) of places; ``ix`` is negative west of Greenwich."""
    ix = (place & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
    return (place - ix) >> 32, ix


def _lattice(seg: dict, step: float) -> Iterator[np.ndarray]:
    """Places of all cells of a segment, some rows at a time."""
    for first in range(0, seg["expected_h"], _ROWS_AT_ONCE):
        yield _places(seg, np.arange(first, min(first + _ROWS_AT_ONCE, seg["expected_h"])), np.arange(seg["expected_w"]), step)


def _box(seg: dict, step: float) -> np.ndarray | None:
    """Every place that a segment's cells may fall on, from the cells along its sides; None if that is more than it has cells.

    A projection maps the inside of a segment to the inside of what its sides map to. Between two cells a side may bend a
    little beyond both, hence one place more all around.
    """
    h, w = seg["expected_h"], seg["expected_w"]
    parts = []
    for row, col in ((np.array([0, h - 1]), np.arange(w)), (np.arange(h), np.array([0, w - 1]))):
        parts.append(_places(seg, row, col, step).ravel())
    side = np.concatenate(parts)
    iy, ix = _apart(side)
    ys, xs = np.arange(iy.min() - 1, iy.max() + 2), np.arange(ix.min() - 1, ix.max() + 2)
    if len(ys) * len(xs) > h * w:
        return None
    return np.add.outer(ys << 32, xs).ravel()


def elevation_tiles(meta: DataFrame, elevation: DataFrame, step: float) -> DataFrame:
    """Altitude of every cell of every city (R7): (city, seg_row, seg_col, h, w, altitude), 0 where the lattice has no value.

    ``elevation`` is (iy, ix, elevation) of a lattice of ``step`` degrees. A segment asks for the few lattice places its cells
    fall on and meets them in one cogroup, so cells need no rows and are never joined.
    """
    # a segment is a short row and much work: with the number named, Spark does not put them all into one task
    spread = [int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS]
    every = cut_lineage(segments(meta), "segments")
    names = every.columns

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg in batch.to_pylist():
                at = _box(seg, step)
                if at is None:
                    at = np.unique(np.concatenate([np.unique(p) for p in _lattice(seg, step)]))
                n, (iy, ix) = len(at), _apart(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seg[k]] * n, kind) for k, kind in zip(KEYS, (pa.string(), pa.int32(), pa.int32()))]
                    + [pa.array(iy.astype(np.int32)), pa.array(ix.astype(np.int32))], [*KEYS, "iy", "ix"])

    asked = every.repartition(*spread).mapInArrow(wanted, "city string, seg_row int, seg_col int, iy int, ix int")
    found = asked.join(elevation.select("iy", "ix", "elevation"), ["iy", "ix"]).select(*KEYS, "iy", "ix", F.col("elevation").cast("double"))

    def fill(seg: pa.Table, known: pa.Table) -> pa.Table:
        seg = seg.select(names).to_pylist()[0]
        iy, ix = _indices(seg, step)
        top, left, height, width = iy.min(), ix.min(), np.ptp(iy) + 1, np.ptp(ix) + 1
        (y, x), value = (known[c].to_numpy() for c in ("iy", "ix")), known["elevation"].fill_null(0.0).to_numpy()
        if height * width <= 4 * iy.size:
            y, x = y - top, x - left
            inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
            box = np.zeros((height, width), np.float32)
            box[y[inside], x[inside]] = value[inside]
            altitude = box[iy - top, ix - left]
        else:  # cells wider than the lattice
            key = (y.astype(np.int64) << 32) + x
            order = np.argsort(key)
            key, value = np.append(key[order], np.iinfo(np.int64).max), np.append(value[order], 0.0)
            place = (iy << 32) + ix
            at = np.searchsorted(key, place)
            altitude = np.where(key[at] == place, value[at], 0.0).astype(np.float32)
        out = {k: [seg[k]] for k in KEYS} | {"h": [seg["expected_h"]], "w": [seg["expected_w"]], "altitude": [altitude.ravel()]}
        kinds = pa.schema([("city", pa.string()), ("seg_row", pa.int32()), ("seg_col", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("altitude", pa.list_(pa.float32()))])
        return pa.table(out, schema=kinds)

    return every.repartition(*spread).groupBy(*KEYS).cogroup(found.repartition(*spread).groupBy(*KEYS)).applyInArrow(
        fill, "city string, seg_row int, seg_col int, h int, w int, altitude array<float>")


def dense_tiles(cells: DataFrame, meta: DataFrame, altitude: DataFrame) -> DataFrame:
    """Tiles of all cities with interleaved channels (R2, R6 to R8): streets from ``cells``, altitude for every position.

    ``cells`` may be runs of cells (``last``), so that a street costs a row per row of the raster it covers.
    """
    shape = meta.select("city", "segment_h", "segment_w")
    joined = cells.withColumn("last", F.col("last" if "last" in cells.columns else "col")).join(shape, "city")
    first_of, last_of = (F.floor(F.col(c) / F.col("segment_w")).cast("int") for c in ("col", "last"))
    # nearly all runs lie in one segment
    keyed = joined.withColumn("seg_col", F.explode(F.when(first_of == last_of, F.array(first_of)).otherwise(F.sequence(first_of, last_of))))
    left = F.col("seg_col") * F.col("segment_w")
    keyed = keyed.select(
        "city", F.floor(F.col("row") / F.col("segment_h")).cast("int").alias("seg_row"), "seg_col", (F.col("row") % F.col("segment_h")).alias("row"),
        F.greatest(F.col("col") - left, F.lit(0)).alias("col"), F.least(F.col("last") - left, F.col("segment_w") - 1).alias("last"), "is_residential")

    def fill(tile: pa.Table, own: pa.Table) -> pa.Table:
        if not tile.num_rows:  # streets at the very edge, beyond the last row or column
            return pa.table({n: pa.array([], k) for n, k in _TILE_KINDS})
        t = tile.drop_columns("altitude").to_pylist()[0]
        data = np.zeros((t["h"], t["w"], CHANNELS), np.float32)
        data[:, :, 1] = values_of(tile["altitude"].combine_chunks())[0].reshape(t["h"], t["w"])
        row, first, last = (own[c].to_numpy().astype(np.int64) for c in ("row", "col", "last"))
        length = np.maximum(np.where(row < t["h"], np.minimum(last, t["w"] - 1) - first + 1, 0), 0)
        # places of all cells: those of a run count up from its first
        at = np.arange(length.sum()) + np.repeat(row * t["w"] + first - np.cumsum(length) + length, length)
        flat = data.reshape(-1, CHANNELS)
        flat[at, 0] = 1
        np.fmax.at(flat[:, 2], at, np.repeat(own["is_residential"].to_numpy().astype(np.float32), length))
        out = [[t[k]] for k in (*KEYS, "h", "w")] + [[CHANNELS], [data.ravel()]]
        return pa.table([pa.array(c, k) for c, (_, k) in zip(out, _TILE_KINDS)], names=[n for n, _ in _TILE_KINDS])

    return altitude.groupBy(*KEYS).cogroup(keyed.groupBy(*KEYS)).applyInArrow(fill, TILE)


_TILE_KINDS = [
    ("city", pa.string()), ("seg_row", pa.int32()), ("seg_col", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()),
    ("data", pa.list_(pa.float32())),
]
