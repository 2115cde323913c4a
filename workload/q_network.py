"""Road-network queries: tags, widths, degrees, adjacency, turns."""

from pyspark.sql import functions as F

from cobblestone.functions import planar, tags
from cobblestone.operators import network
from cobblestone.sources.network import edge_geometry, uniform_tags
from workload.fixtures import view
from workload.registry import query
from workload.sqltext import CLASS_WIDTHS, GEOMETRY, WIDTHS, angle_gap, dist, measure, radius


def edges_of(spark, sf):
    return uniform_tags(view(spark, sf, "fx_edges"))


def ways_of(spark, sf):
    return uniform_tags(view(spark, sf, "fx_ways"))


def geometry_of(spark, sf):
    return edge_geometry(edges_of(spark, sf), view(spark, sf, "fx_nodes"))


@query("P1_parse_measure_tags", uses=("fx_tags",), sql=f"""
SELECT edge_id, round({measure('width')}, 6) AS metres, {measure('width', True)} AS whole_metres FROM fx_tags""")
def parse_tags(spark, sf):
    df = view(spark, sf, "fx_tags")
    w = F.col("width")
    return df.select("edge_id", F.round(tags.parse_measure(w), 6).alias("metres"), tags.parse_measure(w, True).alias("whole_metres"))


@query("P2_mean_list_tags", uses=("fx_edges",), sql=f"""
SELECT u, v, round(({measure('width')} + {measure('lanes')}) / 2, 6) AS mean_pair, round({measure('width')}, 6) AS mean_single FROM fx_edges""")
def mean_tags(spark, sf):
    df = view(spark, sf, "fx_edges")
    return df.select("u", "v", F.round(tags.mean_measure(F.array("width", "lanes")), 6).alias("mean_pair"),
                     F.round(tags.mean_measure(F.array("width")), 6).alias("mean_single"))


@query("P3_J2_edge_width_ladder", uses=("fx_edges",), sql=f"""
WITH {WIDTHS} SELECT u, v, k, round(width_m, 6) AS width_m FROM widths""")
def edge_width(spark, sf):
    return network.with_width(edges_of(spark, sf)).select("u", "v", "k", F.round("width_m", 6).alias("width_m"))


@query("A2_highway_types", uses=("fx_edges",), sql="SELECT DISTINCT highway FROM fx_edges")
def highway_types(spark, sf):
    return network.highway_types(edges_of(spark, sf))


@query("A3_class_widths", uses=("fx_edges",), sql=f"""
WITH {CLASS_WIDTHS} SELECT class, round(class_width, 6) AS class_width FROM class_widths""")
def class_widths(spark, sf):
    return network.class_widths(edges_of(spark, sf)).select("class", F.round("class_width", 6).alias("class_width"))


@query("A4_tag_coverage", uses=("fx_edges",), sql="""
SELECT CASE WHEN coalesce(width, '') <> '' OR coalesce(lanes, '') <> '' THEN 'measured'
  WHEN coalesce(highway, '') <> '' THEN 'class' ELSE 'default' END AS decided_by, count(*) AS n FROM fx_edges GROUP BY 1""")
def tag_coverage(spark, sf):
    return network.tag_coverage(edges_of(spark, sf)).withColumnRenamed("count", "n")


@query("F1_street_subgraph", uses=("fx_edges",), sql="SELECT u, v, k FROM fx_edges WHERE name = 'C7'")
def street_subgraph(spark, sf):
    return network.street_subgraph(edges_of(spark, sf), "C7").select("u", "v", "k")


@query("J1_edge_geometry", uses=("fx_nodes", "fx_edges"), sql="""
SELECT u, v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
FROM fx_edges e JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v""")
def geometry(spark, sf):
    g = F.col("geometry")
    return geometry_of(spark, sf).select("u", "v", g[0]["x"].alias("x1"), g[0]["y"].alias("y1"), g[1]["x"].alias("x2"), g[1]["y"].alias("y2"))


@query("A7_node_degrees", uses=("fx_edges",), sql="""
SELECT node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree
FROM (SELECT u AS node_id, 0 AS i, 1 AS o FROM fx_edges UNION ALL SELECT v, 1, 0 FROM fx_edges) q GROUP BY node_id""")
def degrees(spark, sf):
    return network.degrees(edges_of(spark, sf))


@query("A8_adjacency_list", uses=("fx_edges",), sql="""
SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS place FROM (SELECT u, v FROM fx_edges UNION ALL SELECT v, u FROM fx_edges) e""")
def adjacency_list(spark, sf):
    edges = edges_of(spark, sf).select("u", "v")
    return network.adjacency_list(edges.union(edges.select("v", "u")))


@query("A8_adjacency_matrix", uses=("fx_nodes", "fx_edges"), sql="""
WITH idx AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM fx_nodes)
SELECT DISTINCT a.i AS i, b.i AS j, 1 AS value FROM fx_edges e JOIN idx a ON a.node_id = e.u JOIN idx b ON b.node_id = e.v""")
def adjacency_matrix(spark, sf):
    return network.adjacency_matrix(edges_of(spark, sf), network.dense_index(view(spark, sf, "fx_nodes")))


OCCUPANCY = """
box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_nodes),
dims AS (SELECT *, CAST(floor(150 * ((x1 - x0) / (y1 - y0))) AS INT) AS cols FROM box),
occ AS (SELECT DISTINCT least(CAST(floor((y - y0) / ((y1 - y0) / 150)) AS INT), 149) AS bin_row,
  least(CAST(floor((x - x0) / ((x1 - x0) / cols)) AS INT), cols - 1) AS bin_col, cols FROM fx_nodes, dims)"""


@query("A9_node_occupancy", uses=("fx_nodes",), sql=f"WITH {OCCUPANCY} SELECT bin_row, bin_col FROM occ")
def occupancy(spark, sf):
    return network.occupancy(view(spark, sf, "fx_nodes")).select("bin_row", "bin_col")


@query("A9_occupancy_histogram", uses=("fx_nodes",), sql=f"""
WITH {OCCUPANCY}, t AS (SELECT count(*) AS ones, max(cols) AS cols FROM occ)
SELECT 0 AS value, CAST(cols AS BIGINT) * 150 - ones AS bins FROM t UNION ALL SELECT 1, ones FROM t""")
def occupancy_histogram(spark, sf):
    return network.occupancy_histogram(network.occupancy(view(spark, sf, "fx_nodes")))


@query("J10_neighbour_pairs", uses=("fx_edges",), sql="""
WITH ends AS (SELECT u AS node, v AS n FROM fx_edges UNION SELECT v, u FROM fx_edges)
SELECT a.node, a.n AS n1, b.n AS n2 FROM ends a JOIN ends b ON a.node = b.node AND a.n < b.n""")
def neighbour_pairs(spark, sf):
    return network.neighbour_pairs(edges_of(spark, sf))


TURNS = """turns AS (SELECT a.u, a.v, b.v AS w, a.name AS street FROM fx_edges a JOIN fx_edges b ON b.u = a.v AND b.name = a.name AND a.u <> b.v)"""


@query("J11_turn_pairs", uses=("fx_edges",), sql=f"WITH {TURNS} SELECT u, v, w, street FROM turns")
def turn_pairs(spark, sf):
    return network.turn_pairs(edges_of(spark, sf))


@query("A10_residential_share", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {WIDTHS} SELECT highway, count(*) AS edges, CAST(count(*) FILTER (highway = 'residential' AND u % 60 < 30) AS BIGINT) AS residential,
  round(avg(width_m), 6) AS mean_width FROM widths GROUP BY highway""")
def residential_share(spark, sf):
    edges = network.with_width(edges_of(spark, sf)).withColumn("radius", (F.col("u") % 60).cast("double"))
    flag = tags.is_residential(F.col("highway"), F.col("highway_is_list"), F.col("radius"))
    return edges.groupBy(F.get("highway", F.lit(0)).alias("highway")).agg(
        F.count("*").alias("edges"), F.count_if(flag).alias("residential"), F.round(F.avg("width_m"), 6).alias("mean_width"))


@query("P5_residential_rule", uses=("fx_edges",), sql="""
SELECT u, v, highway = 'residential' AND u % 60 < 30 AS is_residential FROM fx_edges""")
def residential_rule(spark, sf):
    flag = tags.is_residential(F.col("highway"), F.col("highway_is_list"), (F.col("u") % 60).cast("double"))
    return edges_of(spark, sf).select("u", "v", flag.alias("is_residential"))


# --- turning radius with lookahead over chains (fx_ways, 250 m) ----------------------------------

from cobblestone.operators import turning  # noqa: E402

LOOKAHEAD = 250.0
# walks over fx_ways: each step goes on along the same street through a node of degree 2
WALKS = f"""
deg AS (SELECT n, count(*) AS d FROM (SELECT u AS n FROM fx_ways UNION ALL SELECT v FROM fx_ways) q GROUP BY n),
fwd AS (
  SELECT e.u AS s, e.v AS d, e.name, e.u AS c, e.v AS p, {dist('a.x', 'a.y', 'b.x', 'b.y')} AS acc
  FROM fx_ways e JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v
  UNION ALL
  SELECT w.s, w.d, w.name, w.p, e.v, w.acc + {dist('a.x', 'a.y', 'b.x', 'b.y')}
  FROM fwd w JOIN fx_ways e ON e.u = w.p AND e.v <> w.c AND e.name = w.name JOIN deg ON deg.n = w.p AND deg.d <= 2
    JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v
  WHERE w.acc < {LOOKAHEAD}),
bwd AS (
  SELECT e.v AS s, e.u AS d, e.name, e.v AS c, e.u AS p, {dist('a.x', 'a.y', 'b.x', 'b.y')} AS acc
  FROM fx_ways e JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v
  UNION ALL
  SELECT w.s, w.d, w.name, w.p, e.u, w.acc + {dist('a.x', 'a.y', 'b.x', 'b.y')}
  FROM bwd w JOIN fx_ways e ON e.v = w.p AND e.u <> w.c AND e.name = w.name JOIN deg ON deg.n = w.p AND deg.d <= 2
    JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v
  WHERE w.acc < {LOOKAHEAD}),
ahead AS (SELECT w.s, w.d, w.name, n.x, n.y FROM fwd w JOIN fx_nodes n ON n.node_id = w.p WHERE acc >= {LOOKAHEAD}),
behind AS (SELECT w.s, w.d, w.name, n.x, n.y FROM bwd w JOIN fx_nodes n ON n.node_id = w.p WHERE acc >= {LOOKAHEAD})"""
_dev = angle_gap("atan2(c.y - i.y, c.x - i.x)", "atan2(o.y - c.y, o.x - c.x)")
_rad = radius(dist("i.x", "i.y", "c.x", "c.y"), dist("c.x", "c.y", "o.x", "o.y"), dist("o.x", "o.y", "i.x", "i.y"), "1e-4", "0")
WAY_TURNS = WALKS + f""",
way_turns AS (
  SELECT i.d AS u, i.s AS v, o.d AS w, i.name AS street, {_dev} AS deviation, {_rad} AS radius
  FROM behind i JOIN ahead o ON o.s = i.s AND o.name = i.name AND o.d <> i.d JOIN fx_nodes c ON c.node_id = i.s),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY deviation, w) AS rn FROM way_turns) q WHERE rn = 1),
edge_radius AS (SELECT e.u, e.v, e.k, e.name, coalesce(r.radius, CAST('Infinity' AS DOUBLE)) AS radius
  FROM fx_ways e LEFT JOIN best r ON r.u = e.u AND r.v = e.v)"""


def way_inputs(spark, sf):
    return ways_of(spark, sf), view(spark, sf, "fx_nodes")


@query("G4_lookahead_walk", uses=("fx_nodes", "fx_ways"), sql=f"""
WITH RECURSIVE {WALKS}
SELECT 'succ' AS mode, s AS start_node, d AS direction_node, x, y FROM ahead UNION ALL SELECT 'pred', s, d, x, y FROM behind""")
def walks(spark, sf):
    ways, nodes = way_inputs(spark, sf)
    ahead = turning.distant_points(ways, nodes, LOOKAHEAD, "succ").select(F.lit("succ").alias("mode"), "start_node", "direction_node", "p.*")
    behind = turning.distant_points(ways, nodes, LOOKAHEAD, "pred").select(F.lit("pred").alias("mode"), "start_node", "direction_node", "p.*")
    return ahead.union(behind)


@query("P10_turn_geometry", uses=("fx_nodes", "fx_ways"), sql=f"""
WITH RECURSIVE {WAY_TURNS} SELECT u, v, w, street, round(deviation, 6) AS deviation, round(radius, 3) AS radius FROM way_turns""")
def turn_geometry(spark, sf):
    ways, nodes = way_inputs(spark, sf)
    return turning.measured_turns(ways, nodes, LOOKAHEAD).select(
        "u", "v", "w", "street", F.round("deviation", 6).alias("deviation"), F.round("radius", 3).alias("radius"))


@query("W1_best_turn", uses=("fx_nodes", "fx_ways"), sql=f"""
WITH RECURSIVE {WAY_TURNS} SELECT u, v, w, round(deviation, 6) AS deviation FROM best""")
def best_turn(spark, sf):
    ways, nodes = way_inputs(spark, sf)
    return network.best_turn(turning.measured_turns(ways, nodes, LOOKAHEAD)).select("u", "v", "w", F.round("deviation", 6).alias("deviation"))


@query("G5_A6_edge_radius", uses=("fx_nodes", "fx_ways"), sql=f"""
WITH RECURSIVE {WAY_TURNS} SELECT u, v, k, round(radius, 3) AS radius FROM edge_radius""")
def edge_radius(spark, sf):
    ways, nodes = way_inputs(spark, sf)
    return turning.with_radius(ways, nodes, LOOKAHEAD).select("u", "v", "k", F.round("radius", 3).alias("radius"))


@query("A5_street_min_radius", uses=("fx_nodes", "fx_ways"), sql=f"""
WITH RECURSIVE {WAY_TURNS} SELECT name AS street, round(min(radius), 3) AS street_radius FROM edge_radius GROUP BY name HAVING isfinite(min(radius))""")
def street_min_radius(spark, sf):
    ways, nodes = way_inputs(spark, sf)
    return network.street_min_radius(turning.with_radius(ways, nodes, LOOKAHEAD)).select("street", F.round("street_radius", 3).alias("street_radius"))


@query("G6_J3_unified_radius", uses=("fx_nodes", "fx_ways"), sql=f"""
WITH RECURSIVE {WAY_TURNS}, street AS (SELECT name, min(radius) AS r FROM edge_radius GROUP BY name)
SELECT u, v, k, round(CASE WHEN isfinite(s.r) THEN s.r ELSE radius END, 3) AS radius FROM edge_radius e JOIN street s ON s.name = e.name""")
def unified_radius(spark, sf):
    ways, nodes = way_inputs(spark, sf)
    return network.unify_radius(turning.with_radius(ways, nodes, LOOKAHEAD)).select("u", "v", "k", F.round("radius", 3).alias("radius"))


_len = dist("x1", "y1", "x2", "y2")


@query("G7_edge_measurements", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {WIDTHS}, {GEOMETRY}
SELECT u, v, k, round({_len}, 6) AS length_m, round(width_m, 6) AS width_m, highway = 'residential' AND u % 60 < 30 AS is_residential,
  name, CAST(u % 60 AS DOUBLE) AS radius FROM geometry""")
def edge_measurements(spark, sf):
    edges = geometry_of(spark, sf).withColumn("radius", (F.col("u") % 60).cast("double"))
    edges = edges.withColumn("length", planar.line_length(F.col("geometry")))
    out = network.measurements(edges)
    return out.select("u", "v", "k", F.round("length_m", 6).alias("length_m"), F.round("width_m", 6).alias("width_m"),
                      "is_residential", F.get("name", F.lit(0)).alias("name"), "radius")
