"""Street reconstruction queries over the growing street raster."""

from pyspark.sql import functions as F

from cobblestone.functions import geodesy
from cobblestone.operators import components, curvature, morphology, reach, spatial, street_graph, streets
from cobblestone.plans import reconstruct
from cobblestone.session import cut_lineage, scratch_path
from cobblestone.sources import geojson
from workload.fixtures import view
from workload.graph_sql import DISCOVERY, JUNCTIONS, LINES, RADII, STREET_GRAPH, TILE_H, TILE_W, degrees_sql
from workload.q_morphology import BORDER, SIZE, labels_sql, skeleton_of, streets_of
from workload.registry import query
from workload.sqltext import dist

def grid_of(spark, sf):
    cells, height, width = streets_of(spark, sf)
    return cells, reconstruct.Grid(height, width, TILE_H, TILE_W, 1.0, 50.0, 19.0)


def discovered(spark, sf):
    skel, h, w = skeleton_of(spark, sf)
    crossings, lines = streets.discover(skel, h, w, TILE_H, TILE_W)
    return cut_lineage(crossings, "q-crossings"), cut_lineage(lines, "q-streets"), h, w


@query("G9_discovery_cells", uses=("fx_streets",), sql=f"""WITH RECURSIVE {DISCOVERY}
SELECT 'crossroad' AS kind, tile_row, tile_col, row, col, label, conflict FROM crossing_marked UNION ALL SELECT 'street', tile_row, tile_col, row, col, label, conflict FROM street_marked""")
def discovery(spark, sf):
    crossings, lines, _, _ = discovered(spark, sf)
    columns = ["tile_row", "tile_col", "row", "col", "label", "conflict"]
    return crossings.select(F.lit("crossroad").alias("kind"), *columns).union(lines.select(F.lit("street"), *columns))


@query("F11_J9_junctions", uses=("fx_streets",), sql=f"""WITH RECURSIVE {DISCOVERY}, {JUNCTIONS} SELECT tile_row, tile_col, crossroad, street, row, col FROM junction""")
def junctions(spark, sf):
    crossings, lines, _, _ = discovered(spark, sf)
    return streets.junctions(crossings, lines).select("tile_row", "tile_col", "crossroad", "street", "at.row", "at.col")


@query("W3_street_ends", uses=("fx_streets",), sql=f"""WITH RECURSIVE {DISCOVERY}, {JUNCTIONS}
SELECT tile_row, tile_col, street, first(row ORDER BY NOT conflict, crossroad) AS start_row, first(col ORDER BY NOT conflict, crossroad) AS start_col,
  CASE WHEN count(*) > 1 THEN last(row ORDER BY NOT conflict, crossroad) END AS end_row, CASE WHEN count(*) > 1 THEN last(col ORDER BY NOT conflict, crossroad) END AS end_col
FROM junction GROUP BY tile_row, tile_col, street""")
def street_ends(spark, sf):
    crossings, lines, _, _ = discovered(spark, sf)
    ends = streets.street_ends(streets.junctions(crossings, lines))
    return ends.select("tile_row", "tile_col", "street", F.col("start.row").alias("start_row"), F.col("start.col").alias("start_col"),
                       F.col("end.row").alias("end_row"), F.col("end.col").alias("end_col"))


@query("F6_A11_owned_crossroads", uses=("fx_streets",), sql=f"""WITH RECURSIVE {DISCOVERY}
SELECT tile_row, tile_col, label, size, y, x FROM (SELECT tile_row, tile_col, label, count(*) AS size, round(avg(row), 6) AS y, round(avg(col), 6) AS x, avg(row) AS cy, avg(col) AS cx FROM crossing_marked GROUP BY 1, 2, 3) q
WHERE cy >= tile_row * {TILE_H} AND cy < (tile_row + 1) * {TILE_H} AND cx >= tile_col * {TILE_W} AND cx < (tile_col + 1) * {TILE_W}""")
def owned_crossroads(spark, sf):
    crossings, _, _, _ = discovered(spark, sf)
    return street_graph.crossroad_nodes(crossings, TILE_H, TILE_W).select("tile_row", "tile_col", "label", "size", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))


def lines_of(spark, sf):
    crossings, cells, h, w = discovered(spark, sf)
    return streets.order_streets(cells, streets.street_ends(streets.junctions(crossings, cells))), h, w


@query("G10_G11_ordered_streets", uses=("fx_streets",), sql=f"WITH RECURSIVE {DISCOVERY}, {LINES} SELECT tile_row, tile_col, street, position, row, col FROM ordered")
def ordered_streets(spark, sf):
    """Every cell of every line with its place."""
    lines, _, _ = lines_of(spark, sf)
    placed = lines.select("tile_row", "tile_col", "street", F.posexplode(F.arrays_zip("rows", "cols")).alias("position", "c"))
    return placed.select("tile_row", "tile_col", "street", "position", F.col("c.rows").alias("row"), F.col("c.cols").alias("col"))


# axis-parallel lines through the drawn bars, so that SQL can state the march
BARS = f"""bars AS (SELECT node_id AS street, lr * 16 + 1 AS r0, lc * 16 AS c0, 0 AS dr, 1 AS dc FROM fx_nodes WHERE c_mktsegment <> 'MACHINERY'
  UNION ALL SELECT node_id + 1000000000, lr * 16, lc * 16 + 1, 1, 0 FROM fx_nodes WHERE c_mktsegment <> 'BUILDING'),
lines AS (SELECT *, r0 // {TILE_H} AS tile_row, c0 // {TILE_W} AS tile_col FROM bars),
pts AS (SELECT street, tile_row, tile_col, dr, dc, s AS i, least(s + 3, 15) AS j, r0 + dr * s AS pr, c0 + dc * s AS pc, r0 + dr * least(s + 3, 15) AS qr, c0 + dc * least(s + 3, 15) AS qc
  FROM lines, (SELECT unnest(generate_series(0, 14, 3)) AS s) t),
win AS (SELECT p.*, greatest(tile_row * {TILE_H} - 20, 0) AS y0, least((tile_row + 1) * {TILE_H} + 20, h) AS y1, greatest(tile_col * {TILE_W} - 20, 0) AS x0, least((tile_col + 1) * {TILE_W} + 20, w) AS x1 FROM pts p, size),
ray AS (SELECT w.street, w.i, sgn, t, pr + sgn * -dc * t AS row, pc + sgn * dr * t AS col, y0, y1, x0, x1 FROM win w, (VALUES (1), (-1)) s(sgn), (SELECT unnest(generate_series(1, 101)) AS t) k),
miss AS (SELECT r.street, r.i, r.sgn, coalesce(min(t) FILTER (s.row IS NULL OR r.row < y0 OR r.row >= y1 OR r.col < x0 OR r.col >= x1), 102) - 1 AS len FROM ray r LEFT JOIN fx_streets s ON s.row = r.row AND s.col = r.col GROUP BY 1, 2, 3),
edge AS (SELECT m.street, m.i, m.sgn, m.len, s.altitude AS alt FROM miss m JOIN win w ON w.street = m.street AND w.i = m.i JOIN fx_streets s ON s.row = pr + m.sgn * -dc * m.len AND s.col = pc + m.sgn * dr * m.len),
sampled AS (SELECT w.street, w.i, abs(b.altitude - a.altitude) / (abs(qr - pr) + abs(qc - pc)) AS along, l.len + r.len AS width, abs(l.alt - r.alt) AS drop
  FROM win w JOIN fx_streets a ON a.row = pr AND a.col = pc JOIN fx_streets b ON b.row = qr AND b.col = qc
  JOIN edge l ON l.street = w.street AND l.i = w.i AND l.sgn = 1 JOIN edge r ON r.street = w.street AND r.i = w.i AND r.sgn = -1)"""


def bar_metrics(spark, sf):
    cells, h, w = streets_of(spark, sf)
    n = view(spark, sf, "fx_nodes")
    base = n.where("c_mktsegment <> 'MACHINERY'").select(F.col("node_id").alias("street"), (F.col("lr") * 16 + 1).alias("r0"), (F.col("lc") * 16).alias("c0"), F.lit(0).alias("dr"), F.lit(1).alias("dc")).union(
        n.where("c_mktsegment <> 'BUILDING'").select(F.col("node_id") + 1000000000, F.col("lr") * 16, F.col("lc") * 16 + 1, F.lit(1), F.lit(0)))
    steps = F.sequence(F.lit(0), F.lit(15))
    lines = base.select(
        F.floor(F.col("r0") / TILE_H).cast("int").alias("tile_row"), F.floor(F.col("c0") / TILE_W).cast("int").alias("tile_col"), "street",
        F.transform(steps, lambda s: (F.col("r0") + F.col("dr") * s).cast("int")).alias("rows"),
        F.transform(steps, lambda s: (F.col("c0") + F.col("dc") * s).cast("int")).alias("cols"))
    return streets.street_metrics(lines, cells, h, w, TILE_H, TILE_W, halo=20)


@query("A12_A13_street_metrics", uses=("fx_nodes", "fx_streets"), sql=f"""WITH {SIZE}, {BARS}
SELECT street, round(coalesce(median(width) FILTER (width > 0), 0), 6) AS width, round(max(along), 6) AS max_long_slope, round(coalesce(max(drop / width) FILTER (width > 0), 0), 6) AS max_trans_slope FROM sampled GROUP BY street""")
def street_metrics(spark, sf):
    return bar_metrics(spark, sf).select("street", *[F.round(c, 6).alias(c) for c in ("width", "max_long_slope", "max_trans_slope")])


@query("G12_clipped_graph", uses=("fx_streets",), sql=f"WITH RECURSIVE {STREET_GRAPH} SELECT u, v, k, CAST(vertices AS INT) AS vertices, CAST(width AS DOUBLE) AS width FROM raw_edges")
def clipped_graph(spark, sf):
    cells, grid = grid_of(spark, sf)
    nodes, edges = reconstruct.raw_graph(cells, grid)
    return edges.groupBy("u", "v", "k").agg(F.max(F.size("geometry")).alias("vertices"), F.max("width").alias("width"))


# --- graph operators on table-derived nodes ------------------------------------------------------

CLOSE = f"""pt AS (SELECT node_id, x, y, CASE WHEN c_mktsegment = 'BUILDING' THEN 'crossroad' ELSE 'connector' END AS type FROM fx_nodes),
near AS (SELECT a.node_id AS a, b.node_id AS b FROM pt a JOIN pt b ON a.node_id <> b.node_id AND {dist('a.x', 'a.y', 'b.x', 'b.y')} <= 96.5),
cl(n, label) USING KEY (n) AS (SELECT node_id, node_id FROM pt UNION SELECT r.n, min(l.label) FROM cl l JOIN near ON near.a = l.n JOIN recurring.cl r ON r.n = near.b WHERE r.label > l.label GROUP BY r.n),
winner AS (SELECT n AS node_id, first_value(n) OVER (PARTITION BY label ORDER BY type <> 'crossroad', n) AS winner, count(*) OVER (PARTITION BY label) AS members FROM cl JOIN pt ON pt.node_id = n)"""


def typed_nodes(spark, sf):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("crossroad")).otherwise(F.lit("connector"))
    return view(spark, sf, "fx_nodes").select("node_id", "x", "y", kind.alias("type"))


@query("G2_W2_snap_winners", uses=("fx_nodes",), sql=f"WITH RECURSIVE {CLOSE} SELECT node_id, winner FROM winner WHERE members > 1")
def snap_winners(spark, sf):
    return street_graph.snap_winners(typed_nodes(spark, sf), 96.5)


@query("G3_contracted_edges", uses=("fx_nodes", "fx_edges"), sql=f"""WITH RECURSIVE {CLOSE},
e AS (SELECT a.winner AS u, b.winner AS v, e.u AS ou, e.v AS ov FROM fx_edges e JOIN winner a ON a.node_id = e.u JOIN winner b ON b.node_id = e.v WHERE a.winner <> b.winner)
SELECT e.u, e.v, row_number() OVER (PARTITION BY e.u, e.v ORDER BY ou, ov) - 1 AS k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM e JOIN pt a ON a.node_id = e.u JOIN pt b ON b.node_id = e.v""")
def contracted(spark, sf):
    from workload.q_network import geometry_of
    nodes = typed_nodes(spark, sf)
    edges = geometry_of(spark, sf).select("u", "v", "k", "geometry", F.lit(0.0).alias("slope"), F.col("u").cast("double").alias("width"))
    _, out = street_graph.contract(nodes, edges, street_graph.snap_winners(nodes, 96.5))
    g = F.col("geometry")
    return out.select("u", "v", F.col("k").cast("bigint").alias("k"), g[0]["x"].alias("x1"), g[0]["y"].alias("y1"), g[1]["x"].alias("x2"), g[1]["y"].alias("y2"))


def opposite_sql(left: str, limit: int) -> str:
    """Nearest cell of another border within ``limit`` for the cells of ``left``."""
    side = 2 * limit
    return f"""SELECT row, col, distance, to_row, to_col FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY distance, to_row, to_col) AS rn FROM (
  SELECT a.row, a.col, abs(a.row - b.row) + abs(a.col - b.col) AS distance, b.row AS to_row, b.col AS to_col
  FROM (SELECT *, unnest([-1, 0, 1]) + row // {side} AS br FROM {left}) a JOIN (SELECT *, row // {side} AS br FROM fin) b ON a.br = b.br AND a.label <> b.label AND abs(a.row - b.row) + abs(a.col - b.col) <= {limit}) c) q WHERE rn = 1"""


@query("J13_opposite_border", uses=("fx_streets",), sql=f"""WITH RECURSIVE {SIZE}, {BORDER}, {labels_sql('border')},
fin AS MATERIALIZED (SELECT * FROM lab),
near AS MATERIALIZED ({opposite_sql('fin', 16)}), left_over AS MATERIALIZED (SELECT f.* FROM fin f LEFT JOIN near n ON n.row = f.row AND n.col = f.col WHERE n.row IS NULL),
far AS ({opposite_sql('left_over', 128)}) SELECT * FROM near UNION ALL SELECT * FROM far""")
def opposite(spark, sf):
    streets_cells, h, w = streets_of(spark, sf)
    borders = cut_lineage(morphology.border_components(streets_cells, h, w), "q-borders")
    return reach.opposite_cells(borders, h, w).select("row", "col", "distance", "to_row", "to_col")


def flooded(spark, sf):
    handles = view(spark, sf, "fx_nodes").where("c_mktsegment = 'HOUSEHOLD'").select(
        F.col("node_id").alias("handle_id"), (F.col("lr") * 16).alias("row"), (F.col("lc") * 16).alias("col"))
    return reach.flood(view(spark, sf, "fx_streets"), handles, (F.col("row") % 16 != 15) & (F.col("col") % 16 != 15))


@query("G16_U2_flood", uses=("fx_streets", "fx_nodes"), sql="""WITH RECURSIVE handle AS (SELECT n.node_id AS handle_id, n.lr * 16 AS row, n.lc * 16 AS col FROM fx_nodes n JOIN fx_streets s ON s.row = n.lr * 16 AND s.col = n.lc * 16 WHERE n.c_mktsegment = 'HOUSEHOLD'),
flood AS (SELECT handle_id, row, col FROM handle UNION
  SELECT f.handle_id, s.row, s.col FROM flood f, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(di, dj), fx_streets s
  WHERE f.row % 16 <> 15 AND f.col % 16 <> 15 AND s.row = f.row + di AND s.col = f.col + dj)
SELECT handle_id, row, col FROM flood""")
def flood(spark, sf):
    return flooded(spark, sf).visited()


@query("G16_flood_components", uses=("fx_streets", "fx_nodes"), sql=f"""WITH RECURSIVE pass AS (SELECT row, col FROM fx_streets WHERE row % 16 <> 15 AND col % 16 <> 15),
{labels_sql('pass', 'lab', '(VALUES (-1, 0), (0, -1), (0, 1), (1, 0)) o(di, dj)')},
visited AS (SELECT label, row, col FROM lab UNION SELECT l.label, s.row, s.col FROM lab l, (VALUES (-1, 0), (0, -1), (0, 1), (1, 0)) o(di, dj), fx_streets s WHERE s.row = l.row + di AND s.col = l.col + dj)
SELECT 'cell' AS kind, CAST(NULL AS BIGINT) AS handle_id, label, row, col FROM visited
UNION ALL SELECT 'handle', n.node_id, l.label, s.row, s.col FROM fx_nodes n JOIN fx_streets s ON s.row = n.lr * 16 AND s.col = n.lc * 16 LEFT JOIN lab l ON l.row = s.row AND l.col = s.col WHERE n.c_mktsegment = 'HOUSEHOLD'""")
def flood_components(spark, sf):
    out = flooded(spark, sf)
    cells = out.cells.select(F.lit("cell").alias("kind"), F.lit(None).cast("bigint").alias("handle_id"), "label", "row", "col")
    return cells.unionByName(out.handles.withColumn("kind", F.lit("handle")))


# --- whole plans ---------------------------------------------------------------------------------


@query("G13_street_graph_edges", uses=("fx_streets",), sql=f"WITH RECURSIVE {STREET_GRAPH} SELECT u, v, k, CAST(vertices AS INT) AS vertices, round(slope, 6) AS slope, round(CAST(width AS DOUBLE), 6) AS width FROM edge")
def graph_edges(spark, sf):
    cells, grid = grid_of(spark, sf)
    _, edges = reconstruct.street_graph_of(cells, grid)
    return edges.select("u", "v", "k", F.size("geometry").alias("vertices"), F.round("slope", 6).alias("slope"), F.round("width", 6).alias("width"))


@query("G13_street_graph_nodes", uses=("fx_streets",), sql=f"WITH RECURSIVE {STREET_GRAPH} SELECT node_id, type, round({degrees_sql('y', 'x')[0]}, 9) AS lat, round({degrees_sql('y', 'x')[1]}, 9) AS lon FROM node")
def graph_nodes(spark, sf):
    cells, grid = grid_of(spark, sf)
    nodes, _ = reconstruct.street_graph_of(cells, grid)
    return nodes.select("node_id", "type", F.round("y", 9).alias("lat"), F.round("x", 9).alias("lon"))


@query("G15_A14_analysis", uses=("fx_streets",), sql=f"""WITH RECURSIVE {STREET_GRAPH}, {RADII}
SELECT CASE WHEN radius > 1000 THEN 'straight' WHEN radius <= 30 THEN 'sharp' ELSE 'gentle' END AS turn_class, count(*) AS turns, CASE WHEN max(radius) <= 1000 THEN round(avg(radius), 3) END AS value FROM radii GROUP BY 1
UNION ALL SELECT 'mean slope', count(slope), round(avg(slope), 6) FROM edge""")
def analysis(spark, sf):
    cells, grid = grid_of(spark, sf)
    out = reconstruct.analyse(cells, grid)
    report = curvature.radius_report(out.radii)
    slopes = curvature.mean_slope(out.steepness)
    # the radii of nearly straight turns are huge and ill-conditioned: counted only
    mean = F.when(F.col("turn_class") != "straight", F.round("mean_radius", 3))
    return report.select("turn_class", "turns", mean.alias("value")).union(slopes.select(F.lit("mean slope"), "edges", F.round("mean_slope", 6)))


@query("A14_radii_of_the_graph", uses=("fx_streets",), sql=f"WITH RECURSIVE {STREET_GRAPH}, {RADII} SELECT node, n1, n2, kind, round(least(radius, 1000), 3) AS radius FROM radii")
def radii_of_the_graph(spark, sf):
    cells, grid = grid_of(spark, sf)
    radii = reconstruct.analyse(cells, grid).radii
    return radii.select("node", "n1", "n2", "kind", F.round(F.least("radius", F.lit(1000.0)), 3).alias("radius"))


@query("S12_graph_round_trip", uses=("fx_streets",), sql=f"WITH RECURSIVE {STREET_GRAPH} SELECT u, v, k, CAST(vertices AS INT) AS vertices FROM edge")
def graph_round_trip(spark, sf):
    cells, grid = grid_of(spark, sf)
    nodes, edges = reconstruct.snapped_graph(cells, grid)
    path = scratch_path(spark, "graph")
    geojson.write_graph(nodes, edges, path)
    _, back = geojson.read_graph(spark, path)
    return back.select("u", "v", "k", F.size("geometry").alias("vertices"))


@query("S12_stored_lattice", uses=("fx_nodes", "fx_edges"), sql="""
SELECT e.u, e.v, e.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, b.c_mktsegment AS to_segment
FROM fx_edges e JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v""")
def stored_lattice(spark, sf):
    from workload.q_network import geometry_of
    path = scratch_path(spark, "lattice")
    geojson.write_graph(view(spark, sf, "fx_nodes"), geometry_of(spark, sf).select("u", "v", "k", "geometry"), path)
    nodes, edges = geojson.read_graph(spark, path)
    g, to = F.col("geometry"), nodes.select(F.col("node_id").alias("v"), F.col("c_mktsegment").alias("to_segment"))
    return edges.join(to, "v").select(
        "u", "v", "k", g[0]["x"].alias("x1"), g[0]["y"].alias("y1"), g[1]["x"].alias("x2"), g[1]["y"].alias("y2"), "to_segment")


@query("S11_geojson_features", uses=("fx_nodes", "fx_edges"), sql="""
SELECT u, v, k, concat('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[', a.x, ',', a.y, '],[', b.x, ',', b.y, ']]},"properties":{"u":', u, ',"v":', v, ',"slope":0.0,"width":6.5}}') AS feature
FROM fx_edges e JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v""")
def features(spark, sf):
    from workload.q_network import geometry_of
    edges = geometry_of(spark, sf).select("u", "v", "k", "geometry", F.lit(None).cast("double").alias("slope"), F.lit(6.5).alias("width"))
    return geojson.features(edges)
