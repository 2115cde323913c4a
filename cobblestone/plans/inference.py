"""Tiled prediction over whole rasters with feedback between tiles."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cobblestone.operators import raster
from cobblestone.operators.sampling import SampleShape
from cobblestone.session import cut_lineage, scratch_path
from cobblestone.sources.tiles import TILE_FILES

#: Whether a position is hidden, from its row and column.
Region = Callable[[Column, Column], Column]
Predictor = Callable[[np.ndarray, SampleShape], np.ndarray]
PREDICTORS: dict[str, Predictor] = {}


def predictor(name: str):
    """Registers a batch predictor (U1): (tiles, size, size, inputs) to (tiles, inner, inner, outputs)."""

    def keep(fn: Predictor) -> Predictor:
        PREDICTORS[name] = fn
        return fn

    return keep


@predictor("neighbourhood")
def neighbourhood_share(x: np.ndarray, shape: SampleShape) -> np.ndarray:
    """Share of known neighbours (within the context width) that are set; altitude is their mean."""
    reach, inner = shape.crop, shape.size - 2 * shape.crop
    known = 1.0 - x[..., 0]

    def window_sum(a):
        total = np.zeros((a.shape[0], a.shape[1] + 1, a.shape[2] + 1))
        total[:, 1:, 1:] = a.cumsum(axis=1).cumsum(axis=2)
        lo = np.arange(inner)
        hi = lo + 2 * reach + 1
        return total[:, hi][:, :, hi] - total[:, lo][:, :, hi] - total[:, hi][:, :, lo] + total[:, lo][:, :, lo]

    count = np.maximum(window_sum(known), 1.0)
    return np.stack([window_sum(x[..., 1 + k] * known) / count for k in range(shape.outputs)], axis=-1)


@predictor("row_carry")
def carried_along_rows(x: np.ndarray, shape: SampleShape) -> np.ndarray:
    """Every position takes the nearest known one at or left of it, so that feedback carries values along whole rows."""
    inside = slice(shape.crop, shape.size - shape.crop)
    known = np.where(x[..., 0] == 0, np.arange(shape.size), 0)
    at = np.maximum.accumulate(known, axis=2)[:, inside, inside]
    return np.take_along_axis(x[:, inside, :, 1 : 1 + shape.outputs], at[..., None], axis=2)


def _starts(extent: int, stride: int) -> list[int]:
    return [min(s, extent - stride) for s in range(0, extent, stride)]


def reach_right(extent: int, shape: SampleShape) -> int:
    """How many tile columns to the right the context above a tile can touch."""
    stride, half = shape.size - shape.surplus, shape.surplus // 2
    k = math.ceil(half / stride)
    n = math.ceil(extent / stride)
    last = extent - stride  # the last column is moved left to end at the edge, so it may come into reach early
    c = n - 2 - k
    return k + 1 if c >= 0 and last < c * stride + stride + half else k


def tile_plan(spark: SparkSession, rows: int, cols: int, shape: SampleShape) -> DataFrame:
    """Output tiles of a raster of rows x cols inputs (M4): position, owned rectangle, wave.

    Tiles of one wave do not depend on each other: a tile needs its left neighbours and
    the row above up to its right context, hence wave = c + (k + 1) * r. Where the last
    row or column overlaps the one before, the later tile owns the cell.
    """
    if min(rows, cols) < shape.size:
        raise ValueError(f"a raster of {rows} x {cols} is smaller than one tile of {shape.size}")
    stride = shape.size - shape.surplus
    out_h, out_w = rows - shape.surplus, cols - shape.surplus
    n_rows, n_cols = math.ceil(out_h / stride), math.ceil(out_w / stride)
    k = reach_right(out_w, shape)
    ids = spark.range(n_rows * n_cols).select(
        F.floor(F.col("id") / n_cols).cast("int").alias("r"), (F.col("id") % n_cols).cast("int").alias("c")
    )
    y0, x0 = F.least(F.col("r") * stride, F.lit(out_h - stride)), F.least(F.col("c") * stride, F.lit(out_w - stride))
    y1 = F.least((F.col("r") + 1) * stride, F.when(F.col("r") == n_rows - 1, F.lit(out_h)).otherwise(F.lit(out_h - stride)))
    x1 = F.least((F.col("c") + 1) * stride, F.when(F.col("c") == n_cols - 1, F.lit(out_w)).otherwise(F.lit(out_w - stride)))
    return ids.select(
        "r", "c", y0.alias("y0"), x0.alias("x0"), y1.alias("own_y1"), x1.alias("own_x1"),
        (F.col("c") + (k + 1) * F.col("r")).alias("wave"),
    )


def _feeds(oy, ox, ty, tx, stride: int, half: int) -> Column:
    """Whether the context above or left of the tile at (ty, tx) holds cells that the tile at (oy, ox) predicts."""
    above = (oy < ty) & (oy + stride > ty - half) & (ox < tx + stride + half) & (ox + stride > tx - half)
    left = (ox < tx) & (ox + stride > tx - half) & (oy < ty + stride) & (oy + stride > ty)
    return above | left


def tile_dependencies(plan: DataFrame, rows: int, cols: int, shape: SampleShape) -> DataFrame:
    """Pairs of tiles (r, c) that read what (need_r, need_c) predicted, with both waves."""
    stride, half = shape.size - shape.surplus, shape.surplus // 2
    reach = math.ceil(half / stride) + 2
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in range(-reach, 1) for j in range(-reach, reach + 1) if (i, j) < (0, 0)])
    near = plan.select("*", F.explode(steps).alias("s")).select(
        "r", "c", "wave", F.col("y0").alias("ty"), F.col("x0").alias("tx"), (F.col("r") + F.col("s.di")).alias("need_r"), (F.col("c") + F.col("s.dj")).alias("need_c")
    )
    other = plan.select(F.col("r").alias("need_r"), F.col("c").alias("need_c"), F.col("y0").alias("oy"), F.col("x0").alias("ox"), F.col("wave").alias("need_wave"))
    joined = near.join(other, ["need_r", "need_c"])
    feeds = _feeds(*(F.col(c) for c in ("oy", "ox", "ty", "tx")), stride, half)
    return joined.where(feeds).select("r", "c", "wave", "need_r", "need_c", "need_wave")


#: Rows and slanted columns of tiles that one task predicts, one tile after the other.
BLOCK = 8

_PLACE = "r int, c int, y0 int, x0 int, own_y1 int, own_x1 int, br int, bc int"
_NAMES = [kind.split()[0] for kind in _PLACE.split(", ")]
_INTS = pa.schema([(n, pa.int32()) for n in _NAMES])


def _with_arrays(tiles: pa.Table, name: str, values: list[np.ndarray]) -> pa.Table:
    """The places of tiles with one array each beside them."""
    ends = np.cumsum([0, *(v.size for v in values)]).astype(np.int32)
    return tiles.select(_NAMES).cast(_INTS).append_column(name, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v.ravel() for v in values]))))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """All values of a column of arrays, one after the other."""
    return table[name].combine_chunks().flatten().to_numpy()


def _tile_inputs(plan: DataFrame, cells: DataFrame, shape: SampleShape, hidden: Region) -> DataFrame:
    """Dense input array of every tile: raster window and mask, without what other tiles predict.

    The mask is laid over every position of the window, whether the sparse raster has a row for it or not.
    """
    half, size = shape.crop, shape.size
    names = raster.CHANNELS[: shape.inputs - 1]
    windows = plan.select(F.struct("r", "c").alias("cut_id"), "y0", "x0", F.lit(size).alias("h"), F.lit(size).alias("w"))
    seen = raster.cut_cells(windows, cells).select(F.col("cut_id.r").alias("r"), F.col("cut_id.c").alias("c"), "row", "col", *(F.col(n).cast("float") for n in names))
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    masks = plan.select(*_NAMES, F.transform(places, lambda i: F.coalesce(hidden(
        F.col("y0") + F.floor(i / size).cast("int"), F.col("x0") + i % size).cast("boolean"), F.lit(False))).alias("mask"))

    def dense(tile: pa.Table, own: pa.Table) -> pa.Table:
        x = np.zeros((size, size, 1 + len(names)), dtype=np.float32)
        row, col = own["row"].to_numpy(), own["col"].to_numpy()
        for k, name in enumerate(names):
            x[row, col, 1 + k] = own[name].to_numpy()
        mask = np.asarray(tile["mask"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=bool).reshape(size, size)
        x[mask, 0] = 1
        x[mask, 1] = 0
        if len(names) >= 3:
            x[mask, 3] = 0
        border = np.ones((size, size), dtype=bool)
        border[half : size - half, half : size - half] = False
        x[border, 0] = 0
        return _with_arrays(tile.slice(0, 1), "x", [x])

    return masks.groupBy("r", "c").cogroup(seen.groupBy("r", "c")).applyInArrow(dense, f"{_PLACE}, x array<float>")


def _block(r, c, k: int) -> tuple[Column, Column]:
    """Blocks of tiles, slanted by ``k`` columns a row: what a tile reads is in its own block or in blocks above or left of it."""
    return F.floor(r / BLOCK).cast("int"), F.floor((c + k * r) / BLOCK).cast("int")


def _fed(earlier: DataFrame, step: int, rows: int, cols: int, shape: SampleShape) -> DataFrame:
    """What tiles have predicted, once per block of ``step`` that reads it: (br, bc, from_r, from_c, oy, ox, y)."""
    stride, half = shape.size - shape.surplus, shape.surplus // 2
    out_h, out_w = rows - shape.surplus, cols - shape.surplus
    reach, k = math.ceil(half / stride) + 2, reach_right(out_w, shape)
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in range(reach + 1) for j in range(-reach, reach + 1) if (i, j) > (0, 0)])

    def reads(s: Column) -> Column:
        r, c = F.col("r") + s["di"], F.col("c") + s["dj"]
        ty, tx = F.least(r * stride, F.lit(out_h - stride)), F.least(c * stride, F.lit(out_w - stride))
        exists = c.between(0, math.ceil(out_w / stride) - 1) & (r < math.ceil(out_h / stride))
        return exists & (sum(_block(r, c, k)) == step) & _feeds(F.col("y0"), F.col("x0"), ty, tx, stride, half)

    def block_of(s: Column) -> Column:
        return F.struct(*(b.alias(n) for b, n in zip(_block(F.col("r") + s["di"], F.col("c") + s["dj"], k), ("br", "bc"))))

    to = F.array_distinct(F.transform(F.filter(steps, reads), block_of))
    met = earlier.select(F.col("r").alias("from_r"), F.col("c").alias("from_c"), F.col("y0").alias("oy"), F.col("x0").alias("ox"), "y", F.explode(to).alias("b"))
    return met.select("b.br", "b.bc", "from_r", "from_c", "oy", "ox", "y")


def _predict_tiles(inputs: DataFrame, fed: DataFrame | None, parts: int, shape: SampleShape, model: Predictor) -> DataFrame:
    """Prediction of every tile as one array, 0/1 above one half for the binary channels.

    The tiles of a block follow each other. What earlier tiles predicted is laid over a tile's context above and left first, the
    latest tile's on top.
    """
    half, size = shape.crop, shape.size
    inner, outputs = size - 2 * half, raster.CHANNELS[: shape.outputs]
    kept = min(shape.inputs - 1, shape.outputs)
    zone = np.zeros((size, size), dtype=bool)
    zone[: size - half, :half] = zone[:half] = True

    def run(block: pa.Table, seen: pa.Table | None) -> pa.Table:
        block = block.sort_by([("r", "ascending"), ("c", "ascending")])
        windows, known, results = _flat(block, "x").reshape(-1, size, size, shape.inputs), [], []
        if seen is not None and seen.num_rows:
            at = zip(*(seen[n].to_pylist() for n in ("from_r", "from_c", "oy", "ox")))
            known = sorted(zip(at, _flat(seen, "y").reshape(-1, inner, inner, len(outputs))), key=lambda k: k[0])
        for i, (r, c, top, left) in enumerate(zip(*(block[n].to_pylist() for n in ("r", "c", "y0", "x0")))):
            x = windows[i].copy()
            for (from_r, from_c, oy, ox), found in known:
                y, x0 = oy + half - top, ox + half - left
                if (from_r, from_c) >= (r, c) or abs(y) >= size or abs(x0) >= size:
                    continue
                rows, cols = slice(max(y, 0), max(min(y + inner, size), 0)), slice(max(x0, 0), max(min(x0 + inner, size), 0))
                laid, on = found[rows.start - y : rows.stop - y, cols.start - x0 : cols.stop - x0, :kept], zone[rows, cols]
                x[rows, cols, 1 : 1 + kept][on] = laid[on]
            out = np.array(model(x[None], shape), dtype=np.float64)[0]
            for k, name in enumerate(outputs):
                if name != "altitude":
                    out[..., k] = out[..., k] > 0.5
            results.append(out)
            insort(known, ((r, c, top, left), out), key=lambda k: k[0])
        return _with_arrays(block, "y", results)

    schema = f"{_PLACE}, y array<double>"
    tiles = inputs.repartition(parts, "br", "bc").groupBy("br", "bc")
    if fed is None:
        return tiles.applyInArrow(lambda block: run(block, None), schema)
    return tiles.cogroup(fed.repartition(parts, "br", "bc").groupBy("br", "bc")).applyInArrow(run, schema)


def _owned_cells(tiles: DataFrame, shape: SampleShape) -> DataFrame:
    """The cells of predicted tiles, each from the tile that owns it."""
    inner, outputs = shape.size - 2 * shape.crop, raster.CHANNELS[: shape.outputs]

    def cells(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tile = pa.Table.from_batches([batch.slice(i, 1)])
                y0, x0, y1, x1 = (tile[n][0].as_py() for n in ("y0", "x0", "own_y1", "own_x1"))
                y = _flat(tile, "y").reshape(inner, inner, len(outputs))[: y1 - y0, : x1 - x0]
                row, col = (np.arange(a, a + n, dtype=np.int32) for a, n in zip((y0, x0), y.shape))
                columns = [np.repeat(row, len(col)), np.tile(col, len(row)), *(y[..., k].ravel() for k in range(len(outputs)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "col", *outputs])

    return tiles.mapInArrow(cells, "row int, col int, " + ", ".join(f"{n} double" for n in outputs))


def predict(
    cells: DataFrame, rows: int, cols: int, shape: SampleShape, hidden: Region, model: str | Predictor = "neighbourhood"
) -> DataFrame:
    """Predicted raster, ``surplus`` smaller than the input on each axis (M6).

    ``hidden`` tells from the row and column of a position, as Columns, whether it is to be predicted; it counts
    for every position of the raster, with a cell in the sparse table or without. One job cuts the raster into the input
    arrays of all tiles. Blocks of ``BLOCK`` x ``BLOCK`` tiles are predicted step by step, the blocks of a diagonal in one
    parallel job that reads its own arrays and the tiles of the steps it can depend on, and writes a row per tile durably.
    The number of steps follows from the feedback between tiles; every cell is read once, whatever their number.
    """
    run = PREDICTORS[model] if isinstance(model, str) else model
    spark = cells.sparkSession
    stride = shape.size - shape.surplus
    k = reach_right(cols - shape.surplus, shape)
    br, bc = _block(F.col("r"), F.col("c"), k)
    plan = cut_lineage(tile_plan(spark, rows, cols, shape).withColumns({"br": br, "bc": bc, "step": br + bc}), "tile-plan")
    above = math.ceil((shape.surplus // 2) / stride) + 1
    memory = math.ceil(above / BLOCK) + math.ceil((k + 1) * above / BLOCK)
    inputs, done = scratch_path(spark, "tile-inputs"), scratch_path(spark, "tiles")
    arrays = _tile_inputs(plan, cells, shape, hidden).withColumn("step", F.col("br") + F.col("bc"))
    arrays.repartition("br", "bc").write.partitionBy("step").options(**TILE_FILES).parquet(inputs)
    found = spark.read.schema(f"{_PLACE}, y array<double>")
    steps = [(row["step"], row["blocks"]) for row in plan.groupBy("step").agg(F.count_distinct("br").alias("blocks")).orderBy("step").collect()]
    for step, blocks in steps:
        own = spark.read.schema(f"{_PLACE}, x array<float>").parquet(f"{inputs}/step={step}")
        near = [f"{done}/{s}" for s, _ in steps if step - memory <= s < step]
        fed = _fed(found.parquet(*near), step, rows, cols, shape) if near else None
        parts = min(blocks, spark.sparkContext.defaultParallelism)
        _predict_tiles(own, fed, parts, shape, run).write.options(**TILE_FILES).parquet(f"{done}/{step}")
    return _owned_cells(found.parquet(*(f"{done}/{s}" for s, _ in steps)), shape)


def predict_fragment(
    cells: DataFrame, row: int, col: int, height: int, width: int, rows: int, cols: int, shape: SampleShape,
    model: str | Predictor = "neighbourhood",
):
    """Masked prediction of a fragment next to its truth (M8): (row, col, y_, p_ channels) of the predicted area."""
    half = shape.crop
    fragment = raster.read_window(cells, row, col, height, width, rows, cols)
    names = raster.CHANNELS[: shape.outputs]
    found = predict(
        fragment, height, width, shape, lambda r, c: r.between(half, height - half - 1) & c.between(half, width - half - 1), model
    ).withColumnsRenamed({c: f"p_{c}" for c in names})
    truth = fragment.select((F.col("row") - half).alias("row"), (F.col("col") - half).alias("col"), *[F.col(c).alias(f"y_{c}") for c in names])
    return found.join(truth, ["row", "col"], "left").na.fill(0.0, [f"y_{c}" for c in names])
