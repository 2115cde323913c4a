"""City raster to street graph (G13), and the graph's GeoJSON and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cobblestone.operators import curvature, morphology, street_graph, street_tiles, streets
from cobblestone.session import cut_lineage
from cobblestone.sources import geojson


@dataclass(frozen=True)
class Grid:
    """Shape, tiling and place of a raster; origin in degrees for the export.

    By default a street with one crossroad closes on its start, so that snapping merges
    its two ends and the street drops out; ``far_ends`` keeps dead ends as edges. Tiles are what a task holds, with a
    margin of ``march_limit`` cells and the halo; they need not be the segments the raster is stored in.
    """

    height: int
    width: int
    tile_h: int = 1024
    tile_w: int = 1024
    density: float = 1.0
    lat0: float = 0.0
    lon0: float = 0.0
    far_ends: bool = False
    march_limit: int = streets.MARCH_LIMIT


def clean_mask(cells: DataFrame, grid: Grid) -> DataFrame:
    """Street cells without specks and pinholes, with altitude: (row, col, altitude)."""
    return morphology.clean_tiles(cells, grid.height, grid.width)


def raw_graph(cells: DataFrame, grid: Grid, downsampling: int = 1):
    """The graph in raster positions before snapping (G9 to G12, A12), from one pass over the tiles of the thinned mask."""
    mask = cut_lineage(clean_mask(cells, grid), "clean-mask")
    skeleton = morphology.skeletonise(mask, grid.height, grid.width)
    tiling = street_tiles.Tiling(
        grid.height, grid.width, grid.tile_h, grid.tile_w, far_ends=grid.far_ends, downsampling=downsampling, march_limit=grid.march_limit)
    return street_graph.from_parts(cut_lineage(street_tiles.graph_parts(mask, skeleton, tiling), "graph-parts"))


def snapped_graph(cells: DataFrame, grid: Grid, downsampling: int = 1):
    """Nodes and edges in raster positions, close nodes merged."""
    nodes, edges = raw_graph(cells, grid, downsampling)
    nodes = cut_lineage(nodes, "raw-nodes")
    winners = cut_lineage(street_graph.snap_winners(nodes), "snap-winners")
    nodes, edges = street_graph.contract(nodes, edges, winners)
    return cut_lineage(nodes, "nodes"), cut_lineage(edges, "edges")


def street_graph_of(cells: DataFrame, grid: Grid, downsampling: int = 1):
    """Whole raster to street graph in degrees: (nodes, edges)."""
    nodes, edges = snapped_graph(cells, grid, downsampling)
    return street_graph.to_degrees(nodes, edges, grid.lat0, grid.lon0, grid.density)


@dataclass(frozen=True)
class Analysis:
    nodes: DataFrame
    edges: DataFrame
    features: DataFrame
    steepness: DataFrame
    radii: DataFrame


def analyse(cells: DataFrame, grid: Grid) -> Analysis:
    """GeoJSON features and statistics of a predicted raster.

    The statistics are tables: one steepness per edge, one radius per pair of
    neighbours (A14); histograms and reports are aggregates over them (A15, A16).
    """
    nodes, edges = street_graph_of(cells, grid)
    metric_nodes, metric_edges = curvature.project_graph(nodes, edges)
    radii = curvature.node_radii(metric_nodes, metric_edges)
    return Analysis(nodes, edges, geojson.features(edges), edges.select("u", "v", "k", "slope"), radii)
