"""Geometry, gazetteer, area-request and grid-header queries."""

from pyspark.sql import functions as F

from cobblestone.functions import geodesy, lattice, planar
from cobblestone.operators import curvature, network, spatial
from cobblestone.session import cut_lineage
from cobblestone.sources import grid_meta, places
from cobblestone.sources.network import area_network, edge_geometry, nodes_in_area, uniform_tags
from workload.fixtures import view
from workload.q_network import edges_of, geometry_of
from workload.registry import query
from workload.sqltext import GEOMETRY, WIDTHS, angle_gap, dist, radius

# lattice metres read as degrees around (19 E, 50 N), so that the projections see plausible input
LON, LAT = "(19 + x / CAST(1000 AS DOUBLE))", "(49 + y / CAST(100000 AS DOUBLE))"


def lonlat(spark, sf):
    return view(spark, sf, "fx_nodes").select(
        "node_id", (19 + F.col("x") / 1000.0).alias("lon"), (49 + F.col("y") / 100000.0).alias("lat"))


@query("P4_great_circle_length", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH g AS (SELECT node_id, {LON} AS lon, {LAT} AS lat FROM fx_nodes)
SELECT u, v, round(2 * 6371009.0 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 1.0))), 4) AS length_m
FROM fx_edges e JOIN g a ON a.node_id = e.u JOIN g b ON b.node_id = e.v""")
def great_circle(spark, sf):
    nodes = lonlat(spark, sf).select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    edges = edge_geometry(edges_of(spark, sf), nodes)
    return edges.select("u", "v", F.round(geodesy.edge_length(F.col("length"), F.col("geometry")), 4).alias("length_m"))


@query("P6_utm_zone", uses=("fx_nodes",), sql=f"""
SELECT node_id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(ceil((lon + 180.0) / 6.0) AS INT) AS epsg
FROM (SELECT node_id, x / 25.0 - 10 AS lon, y / 100.0 - 2 AS lat FROM fx_nodes) q""")
def utm_zone(spark, sf):
    n = view(spark, sf, "fx_nodes").select("node_id", (F.col("x") / 25.0 - 10).alias("lon"), (F.col("y") / 100.0 - 2).alias("lat"))
    return n.select("node_id", geodesy.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def projection_sql(epsg: int, lon_sql: str = LON, lat_sql: str = LAT) -> str:
    national = epsg == 2180
    lon0 = 19.0 if national else (epsg % 100) * 6 - 183.0
    k0 = geodesy.EPSG_2180_SCALE if national else geodesy.UTM_SCALE
    north = geodesy.EPSG_2180_FALSE_NORTHING if national else 0.0
    scale = repr(k0 * geodesy.RECTIFYING_RADIUS)
    e = repr(geodesy.ECCENTRICITY_LIKE)
    xs = " + ".join(f"CAST({a!r} AS DOUBLE) * cos({2 * (j + 1)} * xi) * sinh({2 * (j + 1)} * eta)" for j, a in enumerate(geodesy.ALPHA))
    ys = " + ".join(f"CAST({a!r} AS DOUBLE) * sin({2 * (j + 1)} * xi) * cosh({2 * (j + 1)} * eta)" for j, a in enumerate(geodesy.ALPHA))
    return f"""SELECT node_id, lon, lat, 500000 + {scale} * (eta + {xs}) AS x, {north} + {scale} * (xi + {ys}) AS y
  FROM (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta
    FROM (SELECT *, radians(lon) - radians({lon0}) AS dl,
      sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t
      FROM (SELECT node_id, {lon_sql} AS lon, {lat_sql} AS lat FROM fx_nodes) g) h) i"""


@query("P7_project_to_metres", uses=("fx_nodes",), sql=f"""
SELECT node_id, 32634 AS epsg, round(x, 3) AS x, round(y, 3) AS y FROM ({projection_sql(32634)}) a
UNION ALL SELECT node_id, 2180, round(x, 3), round(y, 3) FROM ({projection_sql(2180)}) b""")
def project(spark, sf):
    df = lonlat(spark, sf).withColumn("epsg", F.explode(F.array(F.lit(32634), F.lit(2180))))
    p = geodesy.to_projected(F.col("lon"), F.col("lat"), F.col("epsg"))
    return df.select("node_id", "epsg", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"))


@query("P7_project_round_trip", uses=("fx_nodes",), sql=f"""
SELECT node_id, round({LON}, 7) AS lon, round({LAT}, 7) AS lat FROM fx_nodes""")
def project_back(spark, sf):
    p = geodesy.to_projected(F.col("lon"), F.col("lat"), F.lit(32634))
    there = lonlat(spark, sf).select("node_id", p.alias("m"))
    back = geodesy.to_geographic(F.col("m.x"), F.col("m.y"), F.lit(32634))
    return there.select("node_id", F.round(back["x"], 7).alias("lon"), F.round(back["y"], 7).alias("lat"))


@query("P8_local_degrees", uses=("fx_cells",), sql="""
SELECT row, col, round(50.0 - row * 2.0 / 111132.0, 9) AS lat, round(19.0 + col * 2.0 / (111412.0 * cos(radians(50.0))), 9) AS lon FROM fx_cells""")
def local_degrees(spark, sf):
    p = geodesy.local_to_degrees(F.col("row"), F.col("col"), F.lit(50.0), F.lit(19.0), F.lit(2.0))
    return view(spark, sf, "fx_cells").select("row", "col", F.round(p["y"], 9).alias("lat"), F.round(p["x"], 9).alias("lon"))


RIBBON = f"""ribbons AS (SELECT *, (y2 - y1) / {dist('x1', 'y1', 'x2', 'y2')} * (width_m / 2) AS nx,
  (x1 - x2) / {dist('x1', 'y1', 'x2', 'y2')} * (width_m / 2) AS ny FROM geometry WHERE width_m IS NOT NULL)"""


def ribbons_of(spark, sf):
    edges = network.with_width(geometry_of(spark, sf))
    rings = edges.withColumn("ring", planar.ribbon(F.col("geometry"), F.col("width_m")))
    return cut_lineage(rings, "ribbons").where(F.col("ring").isNotNull())


@query("P9_street_ribbons", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {WIDTHS}, {GEOMETRY}, {RIBBON}
SELECT u, v, 0 AS corner, round(x1 + nx, 6) AS x, round(y1 + ny, 6) AS y FROM ribbons
UNION ALL SELECT u, v, 1, round(x2 + nx, 6), round(y2 + ny, 6) FROM ribbons
UNION ALL SELECT u, v, 2, round(x2 - nx, 6), round(y2 - ny, 6) FROM ribbons
UNION ALL SELECT u, v, 3, round(x1 - nx, 6), round(y1 - ny, 6) FROM ribbons""")
def ribbons(spark, sf):
    return ribbons_of(spark, sf).select("u", "v", F.posexplode("ring").alias("corner", "p")).select(
        "u", "v", "corner", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("A1_total_bounds", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {WIDTHS}, {GEOMETRY}, {RIBBON}
SELECT round(min(least(x1, x2) - abs(nx)), 6) AS min_x, round(min(least(y1, y2) - abs(ny)), 6) AS min_y,
  round(max(greatest(x1, x2) + abs(nx)), 6) AS max_x, round(max(greatest(y1, y2) + abs(ny)), 6) AS max_y FROM ribbons""")
def total_bounds(spark, sf):
    b = spatial.total_bounds(ribbons_of(spark, sf))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


_arm = lambda q: f"c.x + (n{q}.x - c.x) * (least(CAST(10 AS DOUBLE), {dist('c.x', 'c.y', f'n{q}.x', f'n{q}.y')}) / {dist('c.x', 'c.y', f'n{q}.x', f'n{q}.y')})"
_army = lambda q: f"c.y + (n{q}.y - c.y) * (least(CAST(10 AS DOUBLE), {dist('c.x', 'c.y', f'n{q}.x', f'n{q}.y')}) / {dist('c.x', 'c.y', f'n{q}.x', f'n{q}.y')})"


@query("P12_arm_points", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH ends AS (SELECT u AS node, v AS n FROM fx_edges UNION SELECT v, u FROM fx_edges)
SELECT node, n, round({_arm('1')}, 6) AS x, round({_army('1')}, 6) AS y
FROM ends JOIN fx_nodes c ON c.node_id = node JOIN fx_nodes n1 ON n1.node_id = n""")
def arm_points(spark, sf):
    out = curvature.arms(view(spark, sf, "fx_nodes"), geometry_of(spark, sf))
    return out.select("node", "n", F.round("arm.x", 6).alias("x"), F.round("arm.y", 6).alias("y"))


RADII = f"""
ends AS (SELECT u AS node, v AS n FROM fx_edges UNION SELECT v, u FROM fx_edges),
deg AS (SELECT n, count(*) AS d FROM (SELECT u AS n FROM fx_edges UNION ALL SELECT v FROM fx_edges) q GROUP BY n),
arm AS (SELECT node, n, c.x AS cx, c.y AS cy, {_arm('1')} AS x, {_army('1')} AS y
  FROM ends JOIN fx_nodes c ON c.node_id = node JOIN fx_nodes n1 ON n1.node_id = n),
radii AS (SELECT a.node, a.n AS n1, b.n AS n2, CASE WHEN d.d <= 2 THEN 'street' ELSE 'junction' END AS kind,
  {radius(dist('a.x', 'a.y', 'a.cx', 'a.cy'), dist('a.cx', 'a.cy', 'b.x', 'b.y'), dist('b.x', 'b.y', 'a.x', 'a.y'), '1e-9', '1e-16')} AS radius
  FROM arm a JOIN arm b ON a.node = b.node AND a.n < b.n JOIN deg d ON d.n = a.node)"""


@query("G14_P11_node_radii", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {RADII} SELECT node, n1, n2, kind, CASE WHEN radius > 1e6 THEN 1e6 ELSE round(radius, 3) END AS radius FROM radii""")
def node_radii(spark, sf):
    out = curvature.node_radii(view(spark, sf, "fx_nodes"), geometry_of(spark, sf))
    # a nearly straight turn has a huge, ill-conditioned radius: shown as 1e6 on both sides
    shown = F.when(F.col("radius") > 1e6, F.lit(1e6)).otherwise(F.round("radius", 3))
    return out.withColumn("radius", shown)


@query("A16_curvature_report", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {RADII} SELECT CASE WHEN radius > 1000 THEN 'straight' WHEN radius <= 30 THEN 'sharp' ELSE 'gentle' END AS turn_class,
  count(*) AS turns, CASE WHEN max(radius) <= 1000 THEN round(avg(radius), 4) END AS mean_radius,
  CASE WHEN max(radius) <= 1000 THEN round(min(radius), 4) END AS min_radius FROM radii GROUP BY 1""")
def curvature_report(spark, sf):
    report = curvature.radius_report(curvature.node_radii(view(spark, sf, "fx_nodes"), geometry_of(spark, sf)))
    bent = F.col("turn_class") != "straight"
    return report.select("turn_class", "turns", F.when(bent, F.round("mean_radius", 4)).alias("mean_radius"),
                         F.when(bent, F.round("min_radius", 4)).alias("min_radius"))


@query("A15_radius_histogram", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {RADII}, b AS (SELECT CAST(greatest(0, least(19, floor(least(radius, 1e9) / 50.0))) AS INT) AS bin, count(*) AS n FROM radii GROUP BY 1)
SELECT bin * 50e0 AS interval_start, (bin + 1) * 50e0 AS interval_end, round(n / sum(n) OVER (), 9) AS share FROM b""")
def radius_histogram(spark, sf):
    radii = curvature.node_radii(view(spark, sf, "fx_nodes"), geometry_of(spark, sf))
    h = curvature.normalised_histogram(radii, "radius", 0.0, 1000.0, 20)
    return h.withColumn("share", F.round("share", 9))


# --- areas, places -------------------------------------------------------------------------------

RING = [(150.0, 120.0), (3020.0, 410.0), (2750.0, 2600.0), (1500.0, 1400.0), (300.0, 2310.0)]
_sides = list(zip(RING, RING[1:] + RING[:1]))
IN_RING = "(" + " + ".join(
    f"CASE WHEN (({ay} > y) <> ({by} > y)) AND x < ({bx} - {ax}) * (y - {ay}) / nullif({by} - {ay}, 0) + {ax} THEN 1 ELSE 0 END"
    for (ax, ay), (bx, by) in _sides) + ") % 2 = 1"


@query("F2_nodes_in_area", uses=("fx_nodes",), sql=f"SELECT node_id FROM fx_nodes WHERE {IN_RING}")
def in_area(spark, sf):
    return nodes_in_area(view(spark, sf, "fx_nodes"), RING).select("node_id")


@query("S7_area_network", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH kept AS (SELECT node_id FROM fx_nodes WHERE {IN_RING})
SELECT u, v, name FROM fx_edges WHERE u IN (SELECT node_id FROM kept) AND v IN (SELECT node_id FROM kept)""")
def area_edges(spark, sf):
    _, edges = area_network(view(spark, sf, "fx_nodes"), edges_of(spark, sf), RING)
    return edges.select("u", "v", F.get("name", F.lit(0)).alias("name"))


@query("J5_residential_points", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {WIDTHS}, {GEOMETRY}, {RIBBON},
pts AS (SELECT node_id AS point_id, x + 50.25 AS px, y + 0.125 AS py FROM fx_nodes),
hit AS (SELECT point_id, bool_or(highway = 'residential') AS is_residential FROM pts JOIN ribbons
    ON px BETWEEN least(x1, x2) - 30 AND greatest(x1, x2) + 30 AND py BETWEEN least(y1, y2) - 30 AND greatest(y1, y2) + 30
    AND ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) BETWEEN 0 AND (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    AND abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= width_m / 2 * {dist('x1', 'y1', 'x2', 'y2')}
  GROUP BY point_id)
SELECT p.point_id, coalesce(h.is_residential, false) AS is_residential FROM pts p LEFT JOIN hit h USING (point_id)""")
def residential_points(spark, sf):
    pts = view(spark, sf, "fx_nodes").select(F.col("node_id").alias("point_id"), (F.col("x") + 50.25).alias("x"), (F.col("y") + 0.125).alias("y"))
    rings = ribbons_of(spark, sf).select("ring", (F.get("highway", F.lit(0)) == "residential").alias("is_residential"))
    return spatial.residential_points(pts, rings).select("point_id", "is_residential")


@query("J8_close_pairs", uses=("fx_nodes",), sql=f"""
SELECT a.node_id AS id_a, b.node_id AS id_b, round({dist('a.x', 'a.y', 'b.x', 'b.y')}, 6) AS distance
FROM fx_nodes a JOIN fx_nodes b ON a.node_id < b.node_id AND {dist('a.x', 'a.y', 'b.x', 'b.y')} <= 100""")
def close_pairs(spark, sf):
    pts = view(spark, sf, "fx_nodes").select(F.col("node_id").alias("id"), "x", "y")
    return spatial.pairs_within(pts, 100.0).withColumn("distance", F.round("distance", 6))


SEG = 300.0


def _clip_sql(ring: str, axis: str, bound: str, op: str) -> str:
    other = "y" if axis == "x" else "x"
    a, b = f"{ring}[i]", f"{ring}[i % len({ring}) + 1]"
    moved = f"{a}.{other} + ({b}.{other} - {a}.{other}) * ({bound} - {a}.{axis}) / nullif({b}.{axis} - {a}.{axis}, 0)"
    cut = f"{{'x': {bound if axis == 'x' else moved}, 'y': {moved if axis == 'x' else bound}}}"
    ia, ib = f"{a}.{axis} {op} {bound}", f"{b}.{axis} {op} {bound}"
    return (f"flatten(list_transform(range(1, len({ring}) + 1), lambda i: CASE WHEN {ia} AND {ib} THEN [{b}] "
            f"WHEN {ia} THEN [{cut}] WHEN {ib} THEN [{cut}, {b}] ELSE [] END))")


CLIPPED = f"""
rings AS (SELECT u, v, [{{'x': x1 + nx, 'y': y1 + ny}}, {{'x': x2 + nx, 'y': y2 + ny}}, {{'x': x2 - nx, 'y': y2 - ny}}, {{'x': x1 - nx, 'y': y1 - ny}}] AS r0,
  least(x1, x2) - abs(nx) AS bx0, greatest(x1, x2) + abs(nx) AS bx1, least(y1, y2) - abs(ny) AS by0, greatest(y1, y2) + abs(ny) AS by1 FROM ribbons),
box AS (SELECT min(bx0) AS gx0, max(bx1) AS gx1, min(by0) AS gy0, max(by1) AS gy1 FROM rings),
tiles AS (SELECT u, v, r0, r AS seg_row, unnest(generate_series(CAST(floor((bx0 - gx0) / {SEG}) AS INT), CAST(floor((bx1 - gx0) / {SEG}) AS INT))) AS seg_col, gx0, gx1, gy0, gy1
  FROM (SELECT *, unnest(generate_series(CAST(floor((gy1 - by1) / {SEG}) AS INT), CAST(floor((gy1 - by0) / {SEG}) AS INT))) AS r FROM rings, box) q),
t AS (SELECT u, v, seg_row, seg_col, r0, gx0 + seg_col * {SEG} AS sx0, least(gx0 + seg_col * {SEG} + {SEG}, gx1) AS sx1,
  greatest(gy1 - seg_row * {SEG} - {SEG}, gy0) AS sy0, gy1 - seg_row * {SEG} AS sy1 FROM tiles),
c1 AS (SELECT *, {_clip_sql('r0', 'x', 'sx0', '>=')} AS r1 FROM t),
c2 AS (SELECT *, {_clip_sql('r1', 'x', 'sx1', '<=')} AS r2 FROM c1),
c3 AS (SELECT *, {_clip_sql('r2', 'y', 'sy0', '>=')} AS r3 FROM c2),
c4 AS (SELECT *, {_clip_sql('r3', 'y', 'sy1', '<=')} AS r4 FROM c3),
areas AS (SELECT u, v, seg_row, seg_col, abs(list_sum(list_transform(range(1, len(r4) + 1), lambda i: r4[i].x * r4[i % len(r4) + 1].y - r4[i % len(r4) + 1].x * r4[i].y))) / 2 AS area FROM c4 WHERE len(r4) > 2)"""


@query("J4_clip_to_segments", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {WIDTHS}, {GEOMETRY}, {RIBBON}, {CLIPPED} SELECT u, v, seg_row, seg_col, round(area, 4) AS area FROM areas WHERE area > 1e-6""")
def clip_segments(spark, sf):
    rings = ribbons_of(spark, sf)
    out = spatial.clip_to_segments(rings, SEG, SEG, spatial.total_bounds(rings))
    return out.where("area > 1e-6").select("u", "v", "seg_row", "seg_col", F.round("area", 4).alias("area"))


@query("A10_residential_per_segment", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {WIDTHS}, {GEOMETRY}, {RIBBON}, {CLIPPED}
SELECT seg_row, seg_col, CAST(count(*) FILTER (highway = 'residential') AS BIGINT) AS residential,
  CAST(count(*) FILTER (highway <> 'residential') AS BIGINT) AS other
FROM areas a JOIN fx_edges e USING (u, v) WHERE area > 1e-6 GROUP BY 1, 2""")
def residential_per_segment(spark, sf):
    rings = ribbons_of(spark, sf)
    out = spatial.clip_to_segments(rings, SEG, SEG, spatial.total_bounds(rings))
    res = F.get("highway", F.lit(0)) == "residential"
    return out.where("area > 1e-6").groupBy("seg_row", "seg_col").agg(
        F.count_if(res).alias("residential"), F.count_if(~res).alias("other"))


@query("P14_P17_segment_boxes", uses=("fx_places",), sql="""
WITH d AS (SELECT place_id, min_x, max_x, min_y, max_y, CAST(ceil((max_y - min_y) / 3.0) AS INT) AS rows, CAST(ceil((max_x - min_x) / 3.0) AS INT) AS cols FROM fx_places),
s AS (SELECT *, CAST(ceil(rows / 90.0) AS INT) AS seg_rows, CAST(ceil(cols / 110.0) AS INT) AS seg_cols FROM d),
g AS (SELECT *, unnest(generate_series(0, seg_cols - 1)) AS seg_col FROM (SELECT *, unnest(generate_series(0, seg_rows - 1)) AS seg_row FROM s) q)
SELECT place_id, rows, cols, seg_row, seg_col, min_x + seg_col * 330.0 AS x0, greatest(max_y - seg_row * 270.0 - 270.0, min_y) AS y0,
  least(min_x + seg_col * 330.0 + 330.0, max_x) AS x1, max_y - seg_row * 270.0 AS y1 FROM g""")
def segment_boxes(spark, sf):
    d = spatial.grid_dimensions(view(spark, sf, "fx_places"), 3.0, 90, 110)
    s = d.withColumn("seg_row", F.explode(F.sequence(F.lit(0), F.col("seg_rows") - 1))).withColumn(
        "seg_col", F.explode(F.sequence(F.lit(0), F.col("seg_cols") - 1)))
    b = spatial.segment_box(F.col("seg_row"), F.col("seg_col"), 330.0, 270.0)
    return s.select("place_id", "rows", "cols", "seg_row", "seg_col", b["min_x"].alias("x0"), b["min_y"].alias("y0"), b["max_x"].alias("x1"), b["max_y"].alias("y1"))


PLACE_PARTS = """parts AS (SELECT place_id, place, kind, trim(CASE WHEN contains(place, ',') THEN split_part(place, ',', 1) ELSE regexp_extract(place, '^(.*)-[^-]*$', 1) END) AS name,
  trim(CASE WHEN contains(place, ',') THEN split_part(place, ',', 2) ELSE regexp_extract(place, '-([^-]*)$', 1) END) AS country, min_x, max_x, min_y, max_y FROM fx_places)"""


def gazetteer(spark, sf):
    return view(spark, sf, "fx_places").select("place_id", "kind", places.split_place(F.col("place")).alias("p"), "min_x", "max_x", "min_y", "max_y").select(
        "place_id", "kind", "p.*", "min_x", "max_x", "min_y", "max_y")


@query("S8_place_resolution", uses=("fx_places",), sql=f"""
WITH {PLACE_PARTS}, req AS (SELECT c_custkey AS request_id, concat(n_name, '-Land') AS place, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT request_id, r.place, r.name, p.place_id, p.kind, concat(replace(lower(r.name), ' ', '_'), '.grid_city') AS file_name
FROM req r LEFT JOIN parts p ON p.name = r.name AND p.country = 'Land'""")
def place_resolution(spark, sf):
    from workload.fixtures import table
    req = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("request_id"), F.concat("n_name", F.lit("-Land")).alias("place"))
    out = places.resolve_places(req, gazetteer(spark, sf))
    return out.select("request_id", "place", "name", "place_id", "kind", places.grid_file_name(F.col("name")).alias("file_name"))


@query("S10_area_to_city", uses=("fx_areas", "fx_places"), sql=f"""
WITH {PLACE_PARTS} SELECT a.place_id AS area_id, (a.min_x + a.max_x) / 2 AS x, (a.min_y + a.max_y) / 2 AS y, CASE WHEN kind = 'city' THEN name END AS city FROM parts a""")
def area_city(spark, sf):
    areas = places.parse_areas(view(spark, sf, "fx_areas").withColumnRenamed("place_id", "area_id"))
    return places.area_places(areas, gazetteer(spark, sf), 800.0).select("area_id", "x", "y", "city")


@query("S10_city_coordinates", uses=("fx_places",), sql=f"""
WITH {PLACE_PARTS} SELECT name, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM parts""")
def city_coordinates(spark, sf):
    g = gazetteer(spark, sf)
    return places.place_coordinates(g.select(F.concat("name", F.lit(", Land")).alias("place")), g)


@query("S15_area_requests", uses=("fx_areas", "fx_places"), sql="""
SELECT place_id, 0 AS corner, min_x AS x, min_y AS y FROM fx_places UNION ALL SELECT place_id, 1, max_x, min_y FROM fx_places
UNION ALL SELECT place_id, 2, max_x, max_y FROM fx_places UNION ALL SELECT place_id, 3, min_x, max_y FROM fx_places
UNION ALL SELECT place_id, 4, min_x, min_y FROM fx_places""")
def area_requests(spark, sf):
    return places.parse_areas(view(spark, sf, "fx_areas")).select("place_id", F.posexplode("ring").alias("corner", "p")).select("place_id", "corner", "p.x", "p.y")


# --- grid headers --------------------------------------------------------------------------------

META = """meta AS (SELECT grid_id, CAST(split_part(header, ';', 1) AS INT) AS version, CAST(split_part(header, ';', 2) AS INT) AS rows, CAST(split_part(header, ';', 3) AS INT) AS cols,
  CAST(split_part(header, ';', 4) AS DOUBLE) AS origin_x, CAST(split_part(header, ';', 5) AS DOUBLE) AS origin_y, CAST(split_part(header, ';', 6) AS DOUBLE) AS density,
  CAST(split_part(header, ';', 7) AS INT) AS segment_h, CAST(split_part(header, ';', 8) AS INT) AS segment_w, split_part(header, ';', 9) AS byteorder,
  CAST(split_part(header, ';', 10) AS INT) AS channels, length(header) + 1 AS header_bytes FROM fx_headers)"""
CATALOGUE = META + """,
cat AS (SELECT *, CASE WHEN seg_row = seg_rows - 1 AND rows % segment_h <> 0 THEN rows % segment_h ELSE segment_h END AS expected_h,
    CASE WHEN seg_col = seg_cols - 1 AND cols % segment_w <> 0 THEN cols % segment_w ELSE segment_w END AS expected_w
  FROM (SELECT *, unnest(generate_series(0, seg_cols - 1)) AS seg_col FROM (SELECT *, unnest(generate_series(0, seg_rows - 1)) AS seg_row
    FROM (SELECT *, CAST(ceil(rows / CAST(segment_h AS DOUBLE)) AS INT) AS seg_rows, CAST(ceil(cols / CAST(segment_w AS DOUBLE)) AS INT) AS seg_cols FROM meta) a) b) c)"""


@query("S3_grid_headers", uses=("fx_headers",), sql=f"WITH {META} SELECT * FROM meta")
def grid_headers(spark, sf):
    return grid_meta.parse_headers(view(spark, sf, "fx_headers"))


@query("S2_segment_catalogue", uses=("fx_headers",), sql=f"""
WITH {CATALOGUE} SELECT grid_id, seg_row, seg_col, expected_h, expected_w,
  CAST(header_bytes + seg_row * segment_h * cols * channels * 4 + seg_col * expected_h * segment_w * channels * 4 AS BIGINT) AS byte_start,
  CAST(expected_h * expected_w * channels * 4 AS BIGINT) AS byte_length FROM cat""")
def segment_catalogue(spark, sf):
    return grid_meta.segment_catalogue(grid_meta.parse_headers(view(spark, sf, "fx_headers"))).select(
        "grid_id", "seg_row", "seg_col", "expected_h", "expected_w", "byte_start", "byte_length")


@query("S5_tile_violations", uses=("fx_headers",), sql=f"""
WITH {CATALOGUE} SELECT grid_id, seg_row, seg_col, segment_h AS h, segment_w AS w, CASE WHEN segment_h <> expected_h THEN 'wrong height' ELSE 'wrong width' END AS reason
FROM cat WHERE segment_h <> expected_h OR segment_w <> expected_w
UNION ALL SELECT DISTINCT grid_id, seg_rows, 0, segment_h, segment_w, 'out of bounds' FROM cat""")
def tile_violations(spark, sf):
    meta = grid_meta.parse_headers(view(spark, sf, "fx_headers"))
    cat = grid_meta.segment_catalogue(meta)
    full = cat.select("grid_id", "seg_row", "seg_col", F.col("segment_h").alias("h"), F.col("segment_w").alias("w"))
    beyond = cat.select("grid_id", F.col("seg_rows").alias("seg_row"), F.lit(0).alias("seg_col"), F.col("segment_h").alias("h"), F.col("segment_w").alias("w")).distinct()
    return grid_meta.tile_violations(full.union(beyond), meta, "grid_id").select("grid_id", "seg_row", "seg_col", "h", "w", "reason")


@query("S6_open_or_create", uses=("fx_headers",), sql=f"""
WITH {META}, req AS (SELECT p_partkey AS grid_id, CAST(100 + p_partkey % 37 AS INT) AS rows, CAST(90 + p_partkey % 40 AS INT) AS cols FROM part)
SELECT r.grid_id, r.rows, r.cols, m.rows AS old_rows, m.cols AS old_cols,
  CASE WHEN m.rows IS NULL THEN 'create' WHEN r.rows <> m.rows OR r.cols <> m.cols THEN 'conflict' ELSE 'open' END AS action
FROM req r LEFT JOIN meta m USING (grid_id)""")
def open_or_create(spark, sf):
    from workload.fixtures import table
    req = table(spark, sf, "part").select(F.col("p_partkey").alias("grid_id"), (100 + F.col("p_partkey") % 37).cast("int").alias("rows"), (90 + F.col("p_partkey") % 40).cast("int").alias("cols"))
    return grid_meta.open_or_create(req, grid_meta.parse_headers(view(spark, sf, "fx_headers")), "grid_id")


@query("P13_cell_mapping", uses=("fx_cells",), sql="""
SELECT row, col, CAST(floor(row / 50.0) AS INT) AS seg_row, CAST(floor(col / 40.0) AS INT) AS seg_col, row % 50 AS row_in_seg, col % 40 AS col_in_seg,
  424000e0 + col * 2e0 AS map_x, 5546000e0 - row * 2e0 AS map_y FROM fx_cells""")
def cell_mapping(spark, sf):
    r, c = F.col("row"), F.col("col")
    return view(spark, sf, "fx_cells").select(
        r, c, *lattice.segment_of(r, c, 50, 40), (r % 50).alias("row_in_seg"), (c % 40).alias("col_in_seg"),
        *lattice.cell_coordinates(r, c, F.lit(424000.0), F.lit(5546000.0), F.lit(2.0)))
