"""A tile of a thinned raster to its part of the street graph, in one pass over its cells.

What ``streets`` does in tables (crossroads, street components, junctions, ends, order, metrics, clipping) happens here on the
arrays of one tile: cells are shipped to tiles once and come back as crossroads and clipped lines. The window for
discovery is the tile's core with ``halo`` cells around it; ground for the marches across a street reaches ``march_limit``
cells further, so that no width depends on where the tiles lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cobblestone.functions import lattice
from cobblestone.operators import components, streets
from cobblestone.operators.morphology import RING

#: Cells around a window that decide which of its cells belong to a crossroad.
_REACH = 2


@dataclass(frozen=True)
class Tiling:
    height: int
    width: int
    tile_h: int
    tile_w: int
    halo: int = streets.HALO
    march_limit: int = streets.MARCH_LIMIT
    density: float = streets.METRIC_DENSITY
    far_ends: bool = False
    downsampling: int = 1

    @property
    def margin(self) -> int:
        return self.halo + max(self.march_limit + 1, _REACH)


_FIELDS = [
    ("tile_row", pa.int32()), ("tile_col", pa.int32()), ("kind", pa.string()), ("label", pa.int64()), ("size", pa.int64()), ("y", pa.float64()),
    ("x", pa.float64()), ("piece", pa.int32()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("slope", pa.float64()),
    ("width", pa.float64()), ("p_y", pa.float64()), ("p_x", pa.float64()), ("p_node", pa.bool_()), ("q_y", pa.float64()), ("q_x", pa.float64()),
    ("q_node", pa.bool_()),
]
SCHEMA = (
    "tile_row int, tile_col int, kind string, label bigint, size bigint, y double, x double, piece int, xs array<double>, ys array<double>,"
    " slope double, width double, p_y double, p_x double, p_node boolean, q_y double, q_x double, q_node boolean"
)


def crossing_mask(skeleton: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    """Crossroad cells of a window: 3 x 3 blocks around inner positions whose ring has three or more runs of ones."""
    h, w = skeleton.shape
    wide = np.zeros((h + 2, w + 2), bool)
    wide[1:-1, 1:-1] = skeleton
    ring = [wide[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i, j in RING]
    runs = sum((~ring[k] & ring[(k + 1) % 8]).astype(np.int8) for k in range(8))
    row, col = np.arange(top, top + h)[:, None], np.arange(left, left + w)[None, :]
    centre = np.zeros_like(wide)
    centre[1:-1, 1:-1] = (runs >= 3) & (row >= 1) & (row <= height - 2) & (col >= 1) & (col <= width - 2)
    return np.logical_or.reduce([centre[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i, j in lattice.BLOCK])


class _Parts:
    """Components of the cells of a window, by their smallest cell key, and whether they reach its rim."""

    def __init__(self, cells: np.ndarray, y0: int, x0: int):
        rows, cols = np.nonzero(cells)  # raster order
        self.rows, self.cols = rows + y0, cols + x0
        n = len(rows)
        none = np.zeros(0, np.int64)
        self.links = components.neighbour_links(self.rows, self.cols, lattice.AROUND) if n else (none, none)
        root = components.group_labels(n, *self.links) if n else none
        self.root = root
        self.key = (self.rows.astype(np.int64) << 32) + self.cols
        self.label = self.key[root]
        rim = (rows == 0) | (rows == cells.shape[0] - 1) | (cols == 0) | (cols == cells.shape[1] - 1)
        self.conflict = np.zeros(n, bool)
        np.logical_or.at(self.conflict, root, rim)
        self.conflict = self.conflict[root]
        self.index = np.full(cells.shape, -1, np.int64)
        self.index[rows, cols] = np.arange(n)


def _street_ends(crossings: _Parts, lines: _Parts, y0: int, x0: int) -> dict[int, tuple[int, int | None]]:
    """Street (its root) -> first and last cell that touches a crossroad: crossroads in conflict first, then raster order."""
    h, w = lines.index.shape
    found = []
    for i, j in lattice.AROUND:
        r, c = crossings.rows - y0 + i, crossings.cols - x0 + j
        ok = np.flatnonzero((r >= 0) & (r < h) & (c >= 0) & (c < w))
        to = lines.index[r[ok], c[ok]]
        ok, to = ok[to >= 0], to[to >= 0]
        found.append(np.column_stack([crossings.label[ok], lines.root[to], crossings.key[ok], np.full(len(ok), i), np.full(len(ok), j), to, crossings.conflict[ok]]))
    touch = np.concatenate(found) if found else np.zeros((0, 7), np.int64)
    touch = touch[np.lexsort((touch[:, 4], touch[:, 3], touch[:, 2], touch[:, 1], touch[:, 0]))]
    first = np.ones(len(touch), bool)
    first[1:] = (touch[1:, :2] != touch[:-1, :2]).any(1)
    touch = touch[first]
    touch = touch[np.lexsort((touch[:, 0], 1 - touch[:, 6], touch[:, 1]))]
    out: dict[int, tuple[int, int | None]] = {}
    for street, cell in touch[:, [1, 5]].tolist():
        start = out.get(street)
        out[street] = (cell, None) if start is None else (start[0], cell)
    return out


def tile_graph(tile_row: int, tile_col: int, row: np.ndarray, col: np.ndarray, altitude: np.ndarray, thin: np.ndarray, t: Tiling) -> list[tuple]:
    """Rows of ``SCHEMA`` of one tile, from its cells (``thin``: a cell of the skeleton, else of the mask)."""
    core_y, core_x = tile_row * t.tile_h, tile_col * t.tile_w
    top, left = max(core_y - t.margin, 0), max(core_x - t.margin, 0)
    bottom, right = min(core_y + t.tile_h + t.margin, t.height), min(core_x + t.tile_w + t.margin, t.width)
    mask = np.zeros((bottom - top, right - left), bool)
    skeleton, ground = np.zeros_like(mask), np.zeros(mask.shape)
    inside = (row >= top) & (row < bottom) & (col >= left) & (col < right)
    row, col, altitude, thin = row[inside] - top, col[inside] - left, altitude[inside], thin[inside]
    skeleton[row[thin], col[thin]] = True
    mask[row[~thin], col[~thin]] = True
    ground[row[~thin], col[~thin]] = altitude[~thin]
    # the window for discovery
    y0, x0 = max(core_y - t.halo, 0), max(core_x - t.halo, 0)
    y1, x1 = min(core_y + t.tile_h + t.halo, t.height), min(core_x + t.tile_w + t.halo, t.width)
    window = np.s_[y0 - top : y1 - top, x0 - left : x1 - left]
    crossing = crossing_mask(skeleton, top, left, t.height, t.width)[window]
    crossings, lines = _Parts(crossing, y0, x0), _Parts(skeleton[window] & ~crossing, y0, x0)
    out: list[tuple] = []
    order = np.argsort(crossings.root, kind="stable")
    cuts = np.flatnonzero(np.diff(crossings.root[order])) + 1
    nodes: dict[int, tuple[float, float]] = {}
    for part in np.split(order, cuts) if len(order) else []:
        y, x = float(crossings.rows[part].mean()), float(crossings.cols[part].mean())
        if core_y <= y < core_y + t.tile_h and core_x <= x < core_x + t.tile_w:
            nodes[int(crossings.root[part[0]])] = y, x
            out.append((tile_row, tile_col, "crossroad", int(crossings.label[part[0]]), len(part), y, x) + (None,) * 11)
    ends = _street_ends(crossings, lines, y0, x0)
    box = (core_x - streets.CLIP_MARGIN, core_y - streets.CLIP_MARGIN,
           min(core_x + t.tile_w, t.width) + streets.CLIP_MARGIN, min(core_y + t.tile_h, t.height) + streets.CLIP_MARGIN)

    def end(y: float, x: float) -> tuple[float, float, bool]:
        i, j = int(np.rint(y)) - y0, int(np.rint(x)) - x0
        at = crossings.index[i, j] if 0 <= i < y1 - y0 and 0 <= j < x1 - x0 else -1
        node = nodes.get(int(crossings.root[at])) if at >= 0 else None
        return (y, x, False) if node is None else (*node, True)

    order = np.argsort(lines.root, kind="stable")
    cuts = np.flatnonzero(np.diff(lines.root[order])) + 1
    neighbours = streets.adjacent(len(order), *lines.links)
    found = []
    for part in np.split(order, cuts) if len(order) else []:
        if len(part) < 2:
            continue
        first = int(part[0])
        line = np.array(streets.order_cells(neighbours, first, *ends.get(first, (None, None)), t.far_ends))
        rows, cols = lines.rows[line], lines.cols[line]
        parts = streets.clip_line(cols.astype(float), rows.astype(float), box)
        if parts:
            found.append((int(lines.label[first]), rows, cols, parts))
    measured = streets.lines_metrics([f[1] - top for f in found], [f[2] - left for f in found], mask, ground, t.density, t.march_limit)
    for (label, rows, _, parts), (width, along, _) in zip(found, measured.tolist()):
        for piece, (xs, ys) in enumerate(parts):
            if t.downsampling > 1:
                keep = np.unique(np.r_[0, np.arange(1, len(xs) - 1, t.downsampling), len(xs) - 1]).astype(int)
                kept = xs[keep], ys[keep]
            else:
                kept = xs, ys
            out.append((tile_row, tile_col, "line", label, len(rows), None, None, piece, *kept, along, width,
                        *end(ys[0], xs[0]), *end(ys[-1], xs[-1])))
    return out


#: Cells on a side of the square that one task gets: several small tiles share their margins.
_SQUARE = 768


def graph_parts(mask: DataFrame, skeleton: DataFrame, tiling: Tiling) -> DataFrame:
    """Crossroads and clipped lines (``SCHEMA``) of every tile of a raster.

    ``mask`` is (row, col, altitude), ``skeleton`` (row, col). What one task holds is a tile with its margin, or as many
    tiles as fill a square of ``_SQUARE`` cells with the margin of that.
    """
    t = tiling
    high, wide = max(1, _SQUARE // t.tile_h), max(1, _SQUARE // t.tile_w)
    tile_rows, tile_cols = -(-t.height // t.tile_h), -(-t.width // t.tile_w)
    cells = mask.select("row", "col", "altitude", F.lit(False).alias("thin")).union(skeleton.select("row", "col", F.lit(None).cast("double"), F.lit(True)))
    inside = F.col("tile_row").between(0, (tile_rows - 1) // high) & F.col("tile_col").between(0, (tile_cols - 1) // wide)
    squares = lattice.covering_tiles(cells, high * t.tile_h, wide * t.tile_w, t.margin).where(inside)

    def solve(table: pa.Table) -> pa.Table:
        row, col = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        altitude = table["altitude"].to_numpy(zero_copy_only=False).astype(float)
        thin = table["thin"].to_numpy(zero_copy_only=False).astype(bool)
        y, x = table["tile_row"][0].as_py() * high, table["tile_col"][0].as_py() * wide
        rows = []
        for tile_row in range(y, min(y + high, tile_rows)):
            band = np.flatnonzero((row >= tile_row * t.tile_h - t.margin) & (row < (tile_row + 1) * t.tile_h + t.margin))
            own = row[band], col[band], altitude[band], thin[band]
            for tile_col in range(x, min(x + wide, tile_cols)):
                near = np.flatnonzero((own[1] >= tile_col * t.tile_w - t.margin) & (own[1] < (tile_col + 1) * t.tile_w + t.margin))
                if len(near):
                    rows += tile_graph(tile_row, tile_col, *(c[near] for c in own), t)
        columns = zip(*rows) if rows else [()] * len(_FIELDS)
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])

    return squares.groupBy("tile_row", "tile_col").applyInArrow(solve, SCHEMA)
