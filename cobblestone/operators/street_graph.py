"""The reconstructed street graph: nodes and edges from clipped lines, snapping, contraction, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cobblestone.functions import geodesy, planar
from cobblestone.operators import components, spatial
from cobblestone.operators.streets import TILE
from cobblestone.session import cut_lineage

# Snapping radius in cells, node types.
SNAP_RADIUS = 5.0
CROSSROAD, CONNECTOR = "crossroad", "connector"


def node_id(y: Column, x: Column) -> Column:
    return F.format_string("%.1f_%.1f", F.bround(y, 1), F.bround(x, 1))


def crossroad_nodes(crossings: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """Crossroads whose centroid lies in the half-open core of their tile."""
    centre = crossings.groupBy(*TILE, "label").agg(F.avg("row").alias("y"), F.avg("col").alias("x"), F.count("*").alias("size"))
    y0, x0 = F.col("tile_row") * tile_h, F.col("tile_col") * tile_w
    core = (F.col("y") >= y0) & (F.col("y") < y0 + tile_h) & (F.col("x") >= x0) & (F.col("x") < x0 + tile_w)
    return centre.where(core).withColumn("node_id", node_id(F.col("y"), F.col("x")))


def assemble(crossings: DataFrame, owned: DataFrame, pieces: DataFrame):
    """Nodes and edges of the raw graph.

    An end of a piece that falls on a cell of an owned crossroad takes its node,
    any other end becomes a connector; pieces from a node to itself are dropped.
    """
    cell_node = crossings.join(owned.select(*TILE, "label", "node_id"), [*TILE, "label"]).select(*TILE, "row", "col", "node_id")
    numbered = pieces.withColumn("geometry", F.zip_with("xs", "ys", planar.point))
    ends = numbered.withColumns({"p": F.get("geometry", F.lit(0)), "q": F.get("geometry", F.size("geometry") - 1)})
    for end, name in (("p", "u"), ("q", "v")):
        here = cell_node.select(
            *TILE, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("node_id").alias(f"_{name}")
        )
        placed = ends.withColumns({"_r": F.rint(f"{end}.y").cast("int"), "_c": F.rint(f"{end}.x").cast("int")})
        ends = placed.join(here, [*TILE, "_r", "_c"], "left").drop("_r", "_c").withColumn(
            name, F.coalesce(f"_{name}", node_id(F.col(f"{end}.y"), F.col(f"{end}.x")))
        )
    ends = cut_lineage(ends, "street-ends")
    connectors = [
        ends.where(F.col(f"_{name}").isNull()).select(F.col(name).alias("node_id"), f"{end}.y", f"{end}.x", F.lit(CONNECTOR).alias("type"))
        for end, name in (("p", "u"), ("q", "v"))
    ]
    every = owned.select("node_id", "y", "x", F.lit(CROSSROAD).alias("type")).union(connectors[0]).union(connectors[1])
    rank = F.struct((F.col("type") != CROSSROAD).alias("r"), "y", "x")
    nodes = every.groupBy("node_id").agg(F.min_by(F.struct("y", "x", "type"), rank).alias("n")).select("node_id", "n.*")
    edges = ends.where(F.col("u") != F.col("v"))
    return nodes, number_parallel(edges, "tile_row", "tile_col", "street", "piece").select("u", "v", "k", "geometry", "slope", "width")


def from_parts(parts: DataFrame):
    """Nodes and edges of the raw graph (G12) from crossroads and clipped lines of tiles (``street_tiles``)."""
    crossroads = parts.where("kind = 'crossroad'").select(node_id(F.col("y"), F.col("x")).alias("node_id"), "y", "x", F.lit(CROSSROAD).alias("type"))
    lines = parts.where("kind = 'line'")
    ends = F.explode(F.array(*[F.struct(F.col(f"{e}_y").alias("y"), F.col(f"{e}_x").alias("x"), F.col(f"{e}_node").alias("node")) for e in "pq"]))
    loose = lines.select(ends.alias("e")).where("not e.node")
    connectors = loose.select(node_id(F.col("e.y"), F.col("e.x")).alias("node_id"), "e.y", "e.x", F.lit(CONNECTOR).alias("type"))
    rank = F.struct((F.col("type") != CROSSROAD).alias("r"), "y", "x")
    nodes = crossroads.union(connectors).groupBy("node_id").agg(F.min_by(F.struct("y", "x", "type"), rank).alias("n")).select("node_id", "n.*")
    named = lines.withColumns({
        "u": node_id(F.col("p_y"), F.col("p_x")), "v": node_id(F.col("q_y"), F.col("q_x")), "geometry": F.zip_with("xs", "ys", planar.point)})
    edges = number_parallel(named.where(F.col("u") != F.col("v")), "tile_row", "tile_col", "label", "piece")
    return nodes, edges.select("u", "v", "k", "geometry", "slope", "width")


def number_parallel(edges: DataFrame, *order: str) -> DataFrame:
    """Key k = 0, 1, ... of parallel edges; a group is the edges between one pair of nodes."""
    return edges.withColumn("k", F.row_number().over(Window.partitionBy("u", "v").orderBy(*order)) - 1)


def snap_winners(nodes: DataFrame, radius: float = SNAP_RADIUS) -> DataFrame:
    """Clusters of nodes closer than ``radius`` and the node each cluster keeps (G2, W2): (node_id, winner).

    Crossroads win over connectors, then the smaller id.
    """
    points = nodes.select(F.col("node_id").alias("id"), "x", "y")
    links = spatial.closeness_links(points, radius).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    member = components.link_components(links).select(F.col("item").alias("node_id"), "component")
    ranked = member.join(nodes.select("node_id", "type"), "node_id")
    rank = F.struct((F.col("type") != CROSSROAD).alias("r"), "node_id")
    winner = ranked.groupBy("component").agg(F.min_by("node_id", rank).alias("winner"))
    return member.join(winner, "component").select("node_id", "winner")


def contract(nodes: DataFrame, edges: DataFrame, winners: DataFrame):
    """The graph on its winners (G3): ends remapped, loops dropped, end vertices moved to the node kept.

    Nodes that neither won a cluster nor end an edge are left out; where nothing snaps, the graph stays as it is.
    """
    if winners.isEmpty():
        return nodes, edges.select("u", "v", "k", "geometry", "slope", "width")
    moved = nodes.join(winners, "node_id", "left").withColumn("winner", F.coalesce("winner", "node_id"))
    at = nodes.select(F.col("node_id").alias("winner"), planar.point(F.col("x"), F.col("y")).alias("at"))
    target = cut_lineage(moved.select("node_id", "winner").join(at, "winner"), "winners")
    a = target.select(F.col("node_id").alias("u"), F.col("winner").alias("wu"), F.col("at").alias("pu"))
    b = target.select(F.col("node_id").alias("v"), F.col("winner").alias("wv"), F.col("at").alias("pv"))
    inner = F.slice("geometry", F.lit(2), F.greatest(F.size("geometry") - 2, F.lit(0)))
    bent = edges.join(a, "u").join(b, "v").select(
        F.col("wu").alias("u"), F.col("wv").alias("v"), F.concat(F.array("pu"), inner, F.array("pv")).alias("geometry"),
        "slope", "width", F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("k").alias("_k"),
    )
    bent = cut_lineage(bent, "contracted")
    used = winners.select(F.col("winner").alias("node_id")).union(bent.select("u")).union(bent.select("v")).distinct()
    kept = number_parallel(bent.where(F.col("u") != F.col("v")), "_u", "_v", "_k")
    return nodes.join(used, "node_id", "left_semi"), kept.select("u", "v", "k", "geometry", "slope", "width")


def to_degrees(nodes: DataFrame, edges: DataFrame, lat0: float, lon0: float, density: float):
    """Raster positions to longitude and latitude on the local plane."""
    args = (F.lit(lat0), F.lit(lon0), F.lit(density))
    p = geodesy.local_to_degrees(F.col("y"), F.col("x"), *args)
    moved = nodes.withColumn("p", p).withColumns({"x": F.col("p.x"), "y": F.col("p.y")}).drop("p")
    line = F.transform("geometry", lambda q: geodesy.local_to_degrees(q["y"], q["x"], *args))
    return moved, edges.withColumn("geometry", line)
