"""From a thinned street raster to street lines: crossroads, junctions, ordering, metrics, clipping.

All steps are keyed by tile; a tile with its halo is a bounded square, so a tile (or
a street in it) is the largest thing one task ever holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cobblestone.functions import lattice
from cobblestone.operators import components, morphology

# Halo of a tile, metre per cell of street metrics, sampling step, march limit, clip margin.
HALO = 10
METRIC_DENSITY = 1.0
SAMPLE_STEP = 3
MARCH_LIMIT = 101
CLIP_MARGIN = 0.1

TILE = ["tile_row", "tile_col"]


def _tiled(cells: DataFrame, tile_h: int, tile_w: int, halo: int, height: int, width: int) -> DataFrame:
    tiles = lattice.covering_tiles(cells.select("row", "col"), tile_h, tile_w, halo)
    last_row, last_col = (height - 1) // tile_h, (width - 1) // tile_w
    return tiles.where(F.col("tile_row").between(0, last_row) & F.col("tile_col").between(0, last_col))


def _rim(tile_h: int, tile_w: int, halo: int, height: int, width: int):
    """Whether a cell lies on the rim of its tile's window (core plus halo, inside the raster)."""
    y0 = F.greatest(F.col("tile_row") * tile_h - halo, F.lit(0))
    x0 = F.greatest(F.col("tile_col") * tile_w - halo, F.lit(0))
    y1 = F.least((F.col("tile_row") + 1) * tile_h + halo, F.lit(height)) - 1
    x1 = F.least((F.col("tile_col") + 1) * tile_w + halo, F.lit(width)) - 1
    return (F.col("row") == y0) | (F.col("row") == y1) | (F.col("col") == x0) | (F.col("col") == x1)


def discover(skeleton: DataFrame, height: int, width: int, tile_h: int, tile_w: int, halo: int = HALO):
    """Crossroad cells and street cells of every tile with their component and conflict flag.

    Two tables (tile_row, tile_col, row, col, label, conflict): a component that
    reaches the rim of its tile's window is in conflict.
    """
    crossings = morphology.crossroad_cells(skeleton, height, width)
    streets = morphology.subtract(skeleton, crossings)
    rim = _rim(tile_h, tile_w, halo, height, width)

    def labelled(cells):
        cells = components.label_within(_tiled(cells, tile_h, tile_w, halo, height, width), TILE)
        # a group is one component of one tile
        return cells.withColumn("conflict", F.bool_or(rim).over(Window.partitionBy(*TILE, "label")))

    return labelled(crossings), labelled(streets)


def junctions(crossings: DataFrame, streets: DataFrame) -> DataFrame:
    """Where each street touches each crossroad, one cell per pair.

    The first touch in raster order of the crossroad's cells counts, and among the
    neighbours of that cell the first in raster order.
    """
    keyed = crossings.withColumn("from_key", lattice.cell_key(F.col("row"), F.col("col")))
    reach = lattice.spread(
        keyed.withColumnRenamed("label", "crossroad"), lattice.AROUND, *TILE, "crossroad", "conflict", "from_key"
    )
    touched = reach.join(streets.select(*TILE, "row", "col", F.col("label").alias("street")), [*TILE, "row", "col"])
    order = F.struct("from_key", "di", "dj")
    return touched.groupBy(*TILE, "crossroad", "street").agg(
        F.min_by(F.struct("row", "col"), order).alias("at"), F.first("conflict").alias("conflict")
    )


def street_ends(joined: DataFrame) -> DataFrame:
    """Start and end cell of streets that touch crossroads.

    Crossroads in conflict come first, then raster order; the first one gives the
    start, the last one the end if there is more than one.
    """
    order = F.struct(~F.col("conflict"), F.col("crossroad"))
    return joined.groupBy(*TILE, "street").agg(
        F.min_by("at", order).alias("start"), F.when(F.count("*") > 1, F.max_by("at", order)).alias("end")
    )


# --- ordering ---------------------------------------------------------------------


def breadth_first(neighbours: list[list[int]], start: int) -> tuple[list[int], dict[int, int]]:
    """Visit order and parents of a breadth-first walk."""
    order, parent = [start], {start: -1}
    for node in order:
        for other in neighbours[node]:
            if other not in parent:
                parent[other] = node
                order.append(other)
    return order, parent


def longest_branches(order: list[int], parent: dict[int, int]) -> tuple[int, int]:
    """Tips of the longest branch of a walk and of the longest one leaving by another neighbour.

    Equal lengths go to the branch that split off first. Without a second way out the
    second tip is the start itself.
    """
    depth, exit_of, branch, extended = {order[0]: 0}, {}, {order[0]: 0}, set()
    split = 0
    for node in order[1:]:
        up = parent[node]
        depth[node] = depth[up] + 1
        exit_of[node] = exit_of.get(up, node)
        if up in extended:
            split += 1
            branch[node] = split
        else:
            branch[node] = branch[up]
            extended.add(up)
    tips = [n for n in order if n not in extended]

    def rank(node):
        return (-depth[node], branch[node])

    first = min(tips, key=rank)
    others = [n for n in tips if depth[n] > 0 and exit_of[n] != exit_of.get(first)]
    return first, min(others, key=rank) if others else order[0]


def order_street(rows: np.ndarray, cols: np.ndarray, start, end, far_ends: bool = False) -> list[int]:
    """Cell indices of one street from start to end (cells come in raster order).

    Missing ends are found on the street itself (G10); the cells follow breadth-first
    from the start, and the end is put last (G11). With only the start known, the end
    is the tip of the longest branch that leaves by another neighbour, which for a
    plain dead end is the start again; ``far_ends`` takes the far tip instead.
    """
    return order_cells(adjacent(len(rows), *components.neighbour_links(rows, cols, lattice.AROUND)), 0, start, end, far_ends)


def adjacent(n: int, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """The neighbours of each of ``n`` cells in raster order, given links a-b."""
    neighbours: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(a.tolist(), b.tolist()):
        neighbours[i].append(j)
        neighbours[j].append(i)
    for around in neighbours:
        around.sort()
    return neighbours


def order_cells(neighbours: list[list[int]], first: int, start, end, far_ends: bool = False) -> list[int]:
    """``order_street`` for the street whose first cell in raster order is ``first``."""
    if start is None:
        start, end = longest_branches(*breadth_first(neighbours, first))
    elif end is None:
        end = longest_branches(*breadth_first(neighbours, start))[0 if far_ends else 1]
    order, _ = breadth_first(neighbours, start)
    return [n for n in order if n != end] + [end]


def order_streets(streets: DataFrame, ends: DataFrame, far_ends: bool = False) -> DataFrame:
    """Streets as ordered lines (G10, G11): (tile_row, tile_col, street, conflict, rows, cols)."""
    joined = streets.withColumnRenamed("label", "street").join(ends, [*TILE, "street"], "left").select(
        *TILE, "street", "conflict", "row", "col",
        lattice.cell_key(F.col("start.row"), F.col("start.col")).alias("start_key"),
        lattice.cell_key(F.col("end.row"), F.col("end.col")).alias("end_key"),
    )

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["street", "row", "col"])
        out = []
        for street, part in pdf.groupby("street", sort=False):
            rows, cols = part["row"].to_numpy("int64"), part["col"].to_numpy("int64")
            keys = (rows << 32) + cols

            def index(column):
                value = part[column].iloc[0]
                return None if pd.isna(value) else int(np.searchsorted(keys, int(value)))

            line = order_street(rows, cols, index("start_key"), index("end_key"), far_ends)
            out.append((
                part["tile_row"].iloc[0], part["tile_col"].iloc[0], street, part["conflict"].iloc[0], rows[line], cols[line],
            ))
        return pd.DataFrame(out, columns=["tile_row", "tile_col", "street", "conflict", "rows", "cols"])

    # cell keys go through pandas, where a missing one would turn a BIGINT column into DOUBLE: keep them as text
    as_text = joined.withColumns({c: F.col(c).cast("string") for c in ("start_key", "end_key")})
    return as_text.groupBy(*TILE).applyInPandas(
        lines, "tile_row int, tile_col int, street bigint, conflict boolean, rows array<int>, cols array<int>"
    )


# --- metrics ----------------------------------------------------------------------


def march(start: np.ndarray, step: np.ndarray, mask: np.ndarray, altitude: np.ndarray, limit: int = MARCH_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Steps from every start along its unit vector until the street ends, and the last altitude met.

    ``limit`` steps at most: what is wider than twice that on one side is an open area, not a street, and counts as so wide.
    """
    n = len(start)
    position = start.astype(float)
    length, last = np.zeros(n, dtype=int), altitude[start[:, 0], start[:, 1]].astype(float)
    alive = np.arange(n)
    for _ in range(limit):
        ahead = position[alive] + step[alive]
        y, x = np.rint(ahead).astype(int).T
        ok = (y >= 0) & (y < mask.shape[0]) & (x >= 0) & (x < mask.shape[1])
        ok[ok] = mask[y[ok], x[ok]]
        alive, y, x = alive[ok], y[ok], x[ok]
        if not len(alive):
            break
        position[alive] = ahead[ok]
        length[alive] += 1
        last[alive] = altitude[y, x]
    return length, last


def lines_metrics(rows: list, cols: list, mask, altitude, density: float, limit: int = MARCH_LIMIT) -> np.ndarray:
    """Width (median), largest slope along and across every line, sampled every third cell (A12); all lines march at once."""
    out = np.zeros((len(rows), 3))
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    samples = np.maximum(-(-(sizes - 1) // SAMPLE_STEP), 0)
    if not samples.sum():
        return out
    line = np.repeat(np.arange(len(rows)), samples)
    first = np.repeat(np.cumsum(sizes) - sizes, samples)
    at = SAMPLE_STEP * (np.arange(len(line)) - np.repeat(np.cumsum(samples) - samples, samples))
    to = np.minimum(at + SAMPLE_STEP, sizes[line] - 1)
    cells = np.column_stack([np.concatenate(rows), np.concatenate(cols)]).astype(np.int64)
    p, q = cells[first + at], cells[first + to]
    delta = q - p
    length = np.hypot(delta[:, 0], delta[:, 1])
    moved = length > 0
    line, p, q, delta, length = line[moved], p[moved], q[moved], delta[moved], length[moved]
    along = np.abs(altitude[q[:, 0], q[:, 1]].astype(float) - altitude[p[:, 0], p[:, 1]]) / (length * density)
    across = np.column_stack([-delta[:, 1], delta[:, 0]]) / length[:, None]
    left, height_left = march(p, across, mask, altitude, limit)
    right, height_right = march(p, -across, mask, altitude, limit)
    width = (left + right) * density
    np.maximum.at(out[:, 1], line, along)
    wide = width > 0
    line, width, drop = line[wide], width[wide], np.abs(height_left[wide] - height_right[wide])
    np.maximum.at(out[:, 2], line, drop / width)
    width = width[np.lexsort((width, line))]  # lines are in order already
    count = np.bincount(line, minlength=len(rows))
    some = np.flatnonzero(count)
    begin, n = (np.cumsum(count) - count)[some], count[some]
    out[some, 0] = (width[begin + (n - 1) // 2] + width[begin + n // 2]) / 2
    return out


def line_metrics(rows, cols, mask, altitude, density: float, limit: int = MARCH_LIMIT) -> tuple[float, float, float]:
    """``lines_metrics`` of one line."""
    return tuple(lines_metrics([rows], [cols], mask, altitude, density, limit)[0].tolist())


def street_metrics(
    lines: DataFrame, cells: DataFrame, height: int, width: int, tile_h: int, tile_w: int, halo: int = HALO,
    density: float = METRIC_DENSITY, march_limit: int = MARCH_LIMIT,
) -> DataFrame:
    """Adds width, max_long_slope and max_trans_slope to street lines.

    ``march_limit`` is the most cells looked at to either side of a line; what is wider counts as so wide.

    Lines and the street cells (row, col, altitude) of their tile's window meet in one
    cogroup, so nothing is exploded per step of a march.
    """
    window = lattice.covering_tiles(cells.select("row", "col", "altitude"), tile_h, tile_w, halo)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)

    def measure(pdf: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pdf.assign(width=[], max_long_slope=[], max_trans_slope=[])
        top = max(int(pdf["tile_row"].iloc[0]) * tile_h - halo, 0)
        left = max(int(pdf["tile_col"].iloc[0]) * tile_w - halo, 0)
        bottom = min((int(pdf["tile_row"].iloc[0]) + 1) * tile_h + halo, height)
        right = min((int(pdf["tile_col"].iloc[0]) + 1) * tile_w + halo, width)
        mask = np.zeros((bottom - top, right - left), dtype=bool)
        altitude = np.zeros(mask.shape)
        y, x = ground["row"].to_numpy() - top, ground["col"].to_numpy() - left
        inside = (y >= 0) & (y < mask.shape[0]) & (x >= 0) & (x < mask.shape[1])
        mask[y[inside], x[inside]] = True
        altitude[y[inside], x[inside]] = ground["altitude"].to_numpy()[inside]
        rows, cols = ([np.asarray(line) - corner for line in pdf[c]] for c, corner in (("rows", top), ("cols", left)))
        measured = lines_metrics(rows, cols, mask, altitude, density, march_limit)
        return pdf.assign(**dict(zip(("width", "max_long_slope", "max_trans_slope"), measured.T)))

    return lines.groupBy(*TILE).cogroup(window.groupBy(*TILE)).applyInPandas(
        measure, schema + ", width double, max_long_slope double, max_trans_slope double"
    )


# --- clipping to the core ---------------------------------------------------------


def clip_line(x: np.ndarray, y: np.ndarray, box) -> list[tuple[np.ndarray, np.ndarray]]:
    """The parts of a polyline inside a box (x0, y0, x1, y1), as coordinate arrays."""
    x0, y0, x1, y1 = box
    if len(x) > 1 and x.min() >= x0 and x.max() <= x1 and y.min() >= y0 and y.max() <= y1:
        return [(x, y)]
    dx, dy = np.diff(x), np.diff(y)
    enter, leave = np.zeros(len(dx)), np.ones(len(dx))
    for start, delta, low, high in ((x[:-1], dx, x0, x1), (y[:-1], dy, y0, y1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (low - start) / delta, (high - start) / delta
        flat = delta == 0
        outside = flat & ((start < low) | (start > high))
        enter = np.maximum(enter, np.where(flat, 0.0, np.minimum(a, b)))
        leave = np.where(outside, -1.0, np.minimum(leave, np.where(flat, 1.0, np.maximum(a, b))))
    hit = np.flatnonzero(enter < leave)
    if not len(hit):
        return []
    joined = (np.diff(hit) == 1) & (leave[hit[:-1]] == 1.0) & (enter[hit[1:]] == 0.0)
    parts = []
    for run in np.split(hit, np.flatnonzero(~joined) + 1):
        xs = np.append(x[run] + enter[run] * dx[run], x[run[-1]] + leave[run[-1]] * dx[run[-1]])
        ys = np.append(y[run] + enter[run] * dy[run], y[run[-1]] + leave[run[-1]] * dy[run[-1]])
        parts.append((xs, ys))
    return parts


def clip_lines(lines: DataFrame, height: int, width: int, tile_h: int, tile_w: int, downsampling: int = 1) -> DataFrame:
    """Street lines cut to the core of their tile (G12): (tile, street, piece, xs, ys, slope, width).

    ``downsampling`` keeps every n-th vertex between the two ends.
    """

    def clip(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if len(row.rows) < 2:
                    continue
                y0, x0 = row.tile_row * tile_h, row.tile_col * tile_w
                box = (
                    x0 - CLIP_MARGIN, y0 - CLIP_MARGIN, min(x0 + tile_w, width) + CLIP_MARGIN,
                    min(y0 + tile_h, height) + CLIP_MARGIN,
                )
                parts = clip_line(np.asarray(row.cols, dtype=float), np.asarray(row.rows, dtype=float), box)
                for piece, (xs, ys) in enumerate(parts):
                    keep = np.unique(np.r_[0, np.arange(1, len(xs) - 1, downsampling), len(xs) - 1]).astype(int)
                    out.append((row.tile_row, row.tile_col, row.street, piece, xs[keep], ys[keep], row.max_long_slope, row.width))
            yield pd.DataFrame(out, columns=["tile_row", "tile_col", "street", "piece", "xs", "ys", "slope", "width"])

    return lines.mapInPandas(
        clip, "tile_row int, tile_col int, street bigint, piece int, xs array<double>, ys array<double>, slope double, width double"
    )
