"""Road network to city roads (G8) and to an enriched city grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cobblestone.functions import geodesy, planar
from cobblestone.operators import network, raster, spatial, turning
from cobblestone.session import cut_lineage
from cobblestone.sources.network import edge_geometry

GEOGRAPHIC_NATIONAL = geodesy.EPSG_2180


def project_nodes(nodes: DataFrame, epsg: DataFrame) -> DataFrame:
    """Nodes in degrees to metres in the CRS of the one-row table ``epsg``."""
    placed = nodes.join(F.broadcast(epsg)).withColumn("m", geodesy.to_projected(F.col("x"), F.col("y"), F.col("epsg")))
    return placed.withColumns({"x": F.col("m.x"), "y": F.col("m.y")}).drop("m", "epsg")


def centre_epsg(nodes: DataFrame) -> DataFrame:
    """UTM zone of the middle of the nodes' bounds, one row."""
    middle = nodes.agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y"))
    return middle.select(geodesy.utm_epsg(F.col("x"), F.col("y")).alias("epsg"))


def city_roads(
    nodes: DataFrame, edges: DataFrame, max_radius: float = 30.0, lookahead: float = 10.0, epsg: int | None = GEOGRAPHIC_NATIONAL
) -> DataFrame:
    """Measured streets with their ribbons (G8), from nodes in degrees.

    Radii are measured in the UTM zone of the network, lengths on the sphere, ribbons in
    ``epsg`` (None takes the UTM zone). Nothing is projected back and forth: every step
    reads the same node table.
    """
    zone = centre_epsg(nodes)
    metric = cut_lineage(project_nodes(nodes, zone), "metric-nodes")
    radius = network.unify_radius(turning.with_radius(edges, metric, lookahead)).select("u", "v", "k", "radius")
    geographic = edge_geometry(edges, nodes).join(radius, ["u", "v", "k"])
    measured = network.measurements(geographic, max_radius).drop("geometry")
    target = metric if epsg is None else project_nodes(nodes, nodes.sparkSession.range(1).select(F.lit(epsg).alias("epsg")))
    shaped = edge_geometry(measured, target)
    return shaped.withColumn("ring", planar.ribbon(F.col("geometry"), F.col("width_m")))


def city_grid(roads: DataFrame, segment_h: int, segment_w: int, density: float = 1.0) -> DataFrame:
    """Street and residential cells of a city in one pass over its roads.

    Row 0 is the northern edge; altitude is added by ``raster.add_elevation`` (R7).
    """
    pieces = cut_lineage(raster.street_pieces(roads, "is_residential"), "pieces")
    touched = raster.rasterise_segments(pieces, segment_h, segment_w, density, keep=("is_residential",))
    cells = touched.groupBy(
        (F.col("seg_row") * segment_h + F.col("row")).alias("row"), (F.col("seg_col") * segment_w + F.col("col")).alias("col")
    ).agg(F.max(F.col("is_residential").cast("double")).alias("is_residential"))
    return cells.select("row", "col", F.lit(1.0).alias("is_street"), F.lit(0.0).alias("altitude"), "is_residential")


def grid_origin(roads: DataFrame, density: float, segment_h: int, segment_w: int) -> DataFrame:
    """Upper left corner and shape of the city grid, one row."""
    bounds = raster.piece_bounds(raster.street_pieces(roads))
    return spatial.grid_dimensions(bounds, density, segment_h, segment_w)
