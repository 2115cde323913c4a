"""Raster queries: rasterising, tiles, windows, overlays, enrichment."""

from pyspark.sql import functions as F

from cobblestone.functions import lattice
from cobblestone.operators import network, raster
from cobblestone.session import scratch_path
from workload.fixtures import cells_side, view
from workload.q_geometry import RIBBON
from workload.q_network import geometry_of
from workload.registry import query
from workload.sqltext import GEOMETRY, WIDTHS, dist


def pieces_of(spark, sf):
    return raster.street_pieces(network.with_width(geometry_of(spark, sf)), "highway")


PIECES = f"""{WIDTHS}, {GEOMETRY}, {RIBBON},
pieces AS (SELECT u, v, highway, least(x1, x2) - abs(nx) AS bx0, greatest(x1, x2) + abs(nx) AS bx1, least(y1, y2) - abs(ny) AS by0, greatest(y1, y2) + abs(ny) AS by1,
  (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, {dist('x1', 'y1', 'x2', 'y2')} AS len, (x2 - x1) / {dist('x1', 'y1', 'x2', 'y2')} AS tx, (y2 - y1) / {dist('x1', 'y1', 'x2', 'y2')} AS ty, width_m / 2 AS half FROM ribbons),
total AS (SELECT min(bx0) AS min_x, max(bx1) AS max_x, min(by0) AS min_y, max(by1) AS max_y FROM pieces)"""

# separating-axis test of a street rectangle against an axis-parallel box
SAT = """x0 < x1 AND y0 < y1 AND x0 < bx1 - 1e-9 AND x1 > bx0 + 1e-9 AND y0 < by1 - 1e-9 AND y1 > by0 + 1e-9
  AND abs(((x0 + x1) / 2 - mx) * tx + ((y0 + y1) / 2 - my) * ty) < len / 2 - 1e-9 + (x1 - x0) / 2 * abs(tx) + (y1 - y0) / 2 * abs(ty)
  AND abs(((x0 + x1) / 2 - mx) * ty - ((y0 + y1) / 2 - my) * tx) < half - 1e-9 + (x1 - x0) / 2 * abs(ty) + (y1 - y0) / 2 * abs(tx)"""


def _candidates(density: float, source: str) -> str:
    """Cells of the bounding boxes in a frame, then the box of each cell cut to the frame's clip box."""
    return f"""cand AS (SELECT *, unnest(generate_series(c0, c1)) AS col FROM (SELECT *, unnest(generate_series(r0, r1)) AS row FROM (
  SELECT *, CAST(greatest(floor((oy - by1) / {density}), 0) AS INT) AS r0, CAST(least(floor((oy - by0) / {density}), h - 1) AS INT) AS r1,
    CAST(greatest(floor((bx0 - ox) / {density}), 0) AS INT) AS c0, CAST(least(floor((bx1 - ox) / {density}), w - 1) AS INT) AS c1 FROM {source}) a WHERE r0 <= r1 AND c0 <= c1) b),
boxes AS (SELECT *, greatest(ox + col * {density}, cx0) AS x0, least(ox + (col + 1) * {density}, cx1) AS x1,
  greatest(oy - (row + 1) * {density}, cy0) AS y0, least(oy - row * {density}, cy1) AS y1 FROM cand)"""


R3_SQL = f"""WITH {PIECES}, framed AS (SELECT *, trunc(min_x) AS ox, trunc(max_y) AS oy, -1e18 AS cx0, 1e18 AS cx1, -1e18 AS cy0, 1e18 AS cy1,
  CAST(floor(trunc(max_y - min_y) / 2e0) AS INT) AS h, CAST(floor(trunc(max_x - min_x) / 2e0) AS INT) AS w FROM pieces, total), {_candidates(2.0, 'framed')}
SELECT DISTINCT row, col FROM boxes WHERE {SAT}"""


@query("R3_rasterise_streets", uses=("fx_nodes", "fx_edges"), sql=R3_SQL)
def rasterise(spark, sf):
    return raster.rasterise(pieces_of(spark, sf), 2.0)


@query("F3_rasterise_residential", uses=("fx_nodes", "fx_edges"), sql=R3_SQL.replace("FROM pieces, total)", "FROM pieces, (SELECT min(bx0) AS min_x, max(bx1) AS max_x, min(by0) AS min_y, max(by1) AS max_y FROM pieces WHERE highway = 'residential') t WHERE highway = 'residential')"))
def rasterise_residential(spark, sf):
    return raster.rasterise(pieces_of(spark, sf).where(F.get("highway", F.lit(0)) == "residential"), 2.0)


@query("R4_rasterise_window", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {PIECES}, win AS (SELECT greatest(min_x, 700.5e0) AS min_x, least(max_x, 2900.25e0) AS max_x, greatest(min_y, 310.75e0) AS min_y, least(max_y, 2100.5e0) AS max_y FROM total),
framed AS (SELECT *, trunc(min_x) AS ox, trunc(max_y) AS oy, min_x AS cx0, max_x AS cx1, min_y AS cy0, max_y AS cy1,
  CAST(floor(trunc(max_y - min_y) / 2e0) AS INT) AS h, CAST(floor(trunc(max_x - min_x) / 2e0) AS INT) AS w FROM pieces, win), {_candidates(2.0, 'framed')}
SELECT DISTINCT row, col FROM boxes WHERE {SAT}""")
def rasterise_window(spark, sf):
    return raster.rasterise_window(pieces_of(spark, sf), 700.5, 2900.25, 310.75, 2100.5, 2.0)


SEGMENTS = f"""dims AS (SELECT *, least(500, CAST(ceil((max_x - min_x) / 2e0) AS INT)) AS sw, least(400, CAST(ceil((max_y - min_y) / 2e0) AS INT)) AS sh FROM total),
segs AS (SELECT *, unnest(generate_series(0, CAST(ceil((max_x - min_x) / (sw * 2e0)) AS INT) - 1)) AS seg_col FROM (
  SELECT *, unnest(generate_series(0, CAST(ceil((max_y - min_y) / (sh * 2e0)) AS INT) - 1)) AS seg_row FROM dims) q),
frames AS (SELECT seg_row, seg_col, cx0, cx1, cy0, cy1, trunc(cx0) AS ox, trunc(cy1) AS oy, CAST(ceil((cy1 - cy0) / 2e0) AS INT) AS h, CAST(ceil((cx1 - cx0) / 2e0) AS INT) AS w
  FROM (SELECT *, min_x + seg_col * sw * 2e0 AS cx0, least(min_x + seg_col * sw * 2e0 + sw * 2e0, max_x) AS cx1, max_y - seg_row * sh * 2e0 AS cy1,
    greatest(max_y - seg_row * sh * 2e0 - sh * 2e0, min_y) AS cy0 FROM segs) f),
framed AS (SELECT * FROM pieces JOIN frames ON bx0 <= cx1 AND bx1 >= cx0 AND by0 <= cy1 AND by1 >= cy0)"""


@query("R5_rasterise_segments", uses=("fx_nodes", "fx_edges"), sql=f"""
WITH {PIECES}, {SEGMENTS}, {_candidates(2.0, 'framed')} SELECT DISTINCT seg_row, seg_col, row, col FROM boxes WHERE {SAT}""")
def rasterise_segments(spark, sf):
    return raster.rasterise_segments(pieces_of(spark, sf), 400, 500, 2.0)


# --- cells and tiles -----------------------------------------------------------------------------


def cells_of(spark, sf):
    return view(spark, sf, "fx_cells")


def stored_tiles(spark, sf):
    side = cells_side(spark, sf)
    return raster.dense_tiles(cells_of(spark, sf), side, side, 150, 100)


@query("R2_dense_tiles", uses=("fx_cells",), sql="""
WITH t AS (SELECT side, unnest(generate_series(0, (side - 1) // 150)) AS seg_row FROM fx_side), g AS (SELECT side, seg_row, unnest(generate_series(0, (side - 1) // 100)) AS seg_col FROM t),
c AS (SELECT CAST(floor(row / 150e0) AS INT) AS seg_row, CAST(floor(col / 100e0) AS INT) AS seg_col, sum(is_street) AS s, sum(CAST(altitude AS FLOAT)) AS a, sum(is_residential) AS r FROM fx_cells GROUP BY 1, 2)
SELECT seg_row, seg_col, least(150, side - seg_row * 150) AS h, least(100, side - seg_col * 100) AS w,
  coalesce(s, 0e0) AS street_cells, round(coalesce(a, 0), 1) AS altitude_sum, coalesce(r, 0e0) AS residential_cells FROM g LEFT JOIN c USING (seg_row, seg_col)""")
def dense_tiles(spark, sf):
    tiles = stored_tiles(spark, sf)
    def total(k):
        picked = F.filter("data", lambda x, i: i % 3 == k)
        return F.aggregate(picked, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return tiles.select("seg_row", "seg_col", "h", "w", total(0).alias("street_cells"), F.round(total(1), 1).alias("altitude_sum"), total(2).alias("residential_cells"))


@query("R1_tiles_to_cells", uses=("fx_cells",), sql="SELECT row, col, is_street, CAST(altitude AS FLOAT) AS altitude, is_residential FROM fx_cells")
def tiles_to_cells(spark, sf):
    return raster.tile_cells(stored_tiles(spark, sf), 150, 100).select("row", "col", F.col("is_street").cast("double").alias("is_street"), "altitude", F.col("is_residential").cast("double").alias("is_residential"))


@query("R9_resegment", uses=("fx_cells",), sql="""
SELECT CAST(floor(row / 90e0) AS INT) AS seg_row, CAST(floor(col / 70e0) AS INT) AS seg_col, row, col, is_street, CAST(altitude AS FLOAT) AS altitude FROM fx_cells""")
def resegment(spark, sf):
    side = cells_side(spark, sf)
    new = raster.resegment(stored_tiles(spark, sf), side, side, (150, 100), (90, 70))
    cells = raster.tile_cells(new, 90, 70)
    return cells.select(*lattice.segment_of(F.col("row"), F.col("col"), 90, 70), "row", "col", F.col("is_street").cast("double").alias("is_street"), "altitude")


@query("F4_window_read", uses=("fx_cells",), sql="""
SELECT row - side // 10 AS row, col - side // 5 AS col, is_street, altitude FROM fx_cells, fx_side
WHERE row >= side // 10 AND row < side // 10 + side * 3 // 4 AND col >= side // 5 AND col < side // 5 + side // 2""")
def window_read(spark, sf):
    side = cells_side(spark, sf)
    return raster.read_window(cells_of(spark, sf), side // 10, side // 5, side * 3 // 4, side // 2, side, side).select("row", "col", "is_street", "altitude")


CUTS = """req AS (SELECT o_orderkey AS cut_id, CAST(o_custkey % (side // 12) AS INT) AS x, CAST(o_orderkey % (side // 13) AS INT) AS y, CAST(20 + o_orderkey % 3 * 4 AS INT) AS h, CAST(24 AS INT) AS w, CAST(16 AS INT) AS surplus, side FROM orders, fx_side),
s AS (SELECT *, greatest(least(surplus, x, y, w, h), 0) AS s FROM req),
cuts AS (SELECT cut_id, {mode} , h, w FROM s)"""
CUTS_PLAIN = CUTS.format(mode="least(CAST(trunc(y - s / 2e0) AS INT), side - h) AS y0, least(CAST(trunc(x - s / 2e0) AS INT), side - w) AS x0")
CUTS_INDEX = CUTS.format(mode="least(CAST(trunc(y * (h - s) - s / 2e0) AS INT), side - h) AS y0, least(CAST(trunc(x * (w - s) - s / 2e0) AS INT), side - w) AS x0")


def cut_requests(spark, sf):
    from workload.fixtures import table
    k, side = F.col("o_orderkey"), cells_side(spark, sf)
    return table(spark, sf, "orders").select(
        k.alias("cut_id"), (F.col("o_custkey") % (side // 12)).cast("int").alias("x"), (k % (side // 13)).cast("int").alias("y"),
        (20 + k % 3 * 4).cast("int").alias("h"), F.lit(24).alias("w"), F.lit(16).alias("surplus"))


@query("F5_cut_windows", uses=("fx_side",), sql=f"""WITH {CUTS_INDEX} SELECT 'index' AS mode, * FROM cuts UNION ALL (WITH {CUTS_PLAIN} SELECT 'plain', * FROM cuts)""")
def cut_windows(spark, sf):
    req, side = cut_requests(spark, sf), cells_side(spark, sf)
    parts = [raster.cut_windows(req, side, side, i).select(F.lit(m).alias("mode"), "*") for m, i in (("index", True), ("plain", False))]
    return parts[0].union(parts[1])


@query("J6_cut_cells", uses=("fx_cells",), sql=f"""WITH {CUTS_INDEX}
SELECT cut_id, count(*) AS cells, sum(is_street) AS street, CAST(sum((row - y0) * 1000 + col - x0) AS BIGINT) AS place_sum
FROM cuts JOIN fx_cells ON row >= y0 AND row < y0 + h AND col >= x0 AND col < x0 + w GROUP BY cut_id""")
def cut_cells(spark, sf):
    side = cells_side(spark, sf)
    windows = raster.cut_windows(cut_requests(spark, sf), side, side, True)
    out = raster.cut_cells(windows, cells_of(spark, sf).select("row", "col", "is_street"), 32)
    return out.groupBy("cut_id").agg(F.count("*").alias("cells"), F.sum("is_street").alias("street"), F.sum(F.col("row") * 1000 + F.col("col")).alias("place_sum"))


@query("J12_overlay_window", uses=("fx_cells", "fx_streets"), sql="""
SELECT row, col, is_street, altitude FROM fx_cells WHERE NOT (row BETWEEN 100 AND 199 AND col BETWEEN 50 AND 209)
UNION ALL SELECT row + 100, col + 50, is_street, altitude FROM fx_streets WHERE row < 100 AND col < 160""")
def overlay_window(spark, sf):
    cells = cells_of(spark, sf).select("row", "col", "is_street", "altitude")
    fragment = view(spark, sf, "fx_streets").select("row", "col", "is_street", "altitude")
    return raster.overlay(cells, fragment, 100, 50, 100, 160)


@query("J12_upsert_cells", uses=("fx_cells", "fx_streets"), sql="""
SELECT row, col, coalesce(s.is_street, c.is_street) AS is_street, coalesce(s.altitude, c.altitude) AS altitude FROM fx_cells c FULL JOIN fx_streets s USING (row, col)""")
def upsert_cells(spark, sf):
    cells = cells_of(spark, sf).select("row", "col", "is_street", "altitude")
    return raster.upsert(cells, view(spark, sf, "fx_streets").select("row", "col", "is_street", "altitude"))


@query("J7_F7_halo_tiles", uses=("fx_streets",), sql="""
WITH t AS (SELECT *, unnest(generate_series(CAST(floor((col - 10) / 100e0) AS INT), CAST(floor((col + 10) / 100e0) AS INT))) AS tile_col FROM (
  SELECT *, unnest(generate_series(CAST(floor((row - 10) / 120e0) AS INT), CAST(floor((row + 10) / 120e0) AS INT))) AS tile_row FROM fx_streets) q)
SELECT tile_row, tile_col, row, col FROM t
WHERE tile_row >= 0 AND tile_col >= 0 AND tile_row < ceil((SELECT max(row) + 1 FROM fx_streets) / 120e0) AND tile_col < ceil((SELECT max(col) + 1 FROM fx_streets) / 100e0)""")
def halo_tiles(spark, sf):
    streets = view(spark, sf, "fx_streets")
    s = streets.agg(F.max("row"), F.max("col")).first()
    return raster.halo_tiles(streets, s[0] + 1, s[1] + 1, 120, 100).select("tile_row", "tile_col", "row", "col")


@query("F7_live_tiles", uses=("fx_cells",), sql="""
SELECT CAST(floor(row / 8e0) AS INT) AS tile_row, CAST(floor(col / 8e0) AS INT) AS tile_col, count(*) AS cells FROM fx_cells GROUP BY 1, 2 HAVING max(is_street) > 0""")
def live_tiles(spark, sf):
    side = cells_side(spark, sf)
    return raster.halo_tiles(cells_of(spark, sf), side, side, 8, 8, 0).groupBy("tile_row", "tile_col").agg(F.count("*").alias("cells"))


@query("P15_threshold", uses=("fx_pred",), sql="SELECT l_orderkey, l_linenumber, CASE WHEN y_pred > 0.5 THEN 1e0 ELSE 0e0 END AS y_pred FROM fx_pred")
def threshold(spark, sf):
    return raster.threshold(view(spark, sf, "fx_pred"), "y_pred").select("l_orderkey", "l_linenumber", "y_pred")


@query("P16_fill_channel", uses=("fx_cells",), sql="SELECT row, col, is_street, altitude, 0e0 AS is_residential FROM fx_cells")
def fill_channel(spark, sf):
    return raster.fill_channel(cells_of(spark, sf), "is_residential")


@query("A17_segment_ranges", uses=("fx_cells",), sql="""
SELECT CAST(floor(row / 100e0) AS INT) AS seg_row, CAST(floor(col / 100e0) AS INT) AS seg_col, min(is_street) AS min_is_street, max(is_street) AS max_is_street,
  min(altitude) AS min_altitude, max(altitude) AS max_altitude, min(is_residential) AS min_is_residential, max(is_residential) AS max_is_residential FROM fx_cells GROUP BY 1, 2""")
def segment_ranges(spark, sf):
    return raster.segment_ranges(cells_of(spark, sf), 100, 100)


@query("S9_elevation_lookup", uses=("fx_cells", "fx_elev"), sql="""
SELECT row, col, coalesce(elevation, 0e0) AS elevation FROM fx_cells LEFT JOIN fx_elev ON ti = CAST(floor(row / 32e0) AS INT) AND tj = CAST(floor(col / 32e0) AS INT)""")
def elevation_lookup(spark, sf):
    elev = view(spark, sf, "fx_elev").select(F.col("ti").alias("iy"), F.col("tj").alias("ix"), "elevation")
    return raster.elevation_of(cells_of(spark, sf), elev, "row", "col", 32.0, 32.0).select("row", "col", "elevation")


@query("R7_add_elevation", uses=("fx_cells", "fx_elev"), sql="""
SELECT row, col, is_street, coalesce(elevation, 0e0) AS altitude FROM (SELECT row, col, is_street, 50e0 - row * 0.01e0 AS lat, 19e0 + col * 0.01e0 AS lon FROM fx_cells) c
LEFT JOIN fx_elev ON ti + 740 = CAST(floor(lat / 0.0625e0) AS INT) AND tj + 304 = CAST(floor(lon / 0.0625e0) AS INT)""")
def add_elevation(spark, sf):
    elev = view(spark, sf, "fx_elev").select((F.col("ti") + 740).alias("iy"), (F.col("tj") + 304).alias("ix"), "elevation")
    return raster.add_elevation(cells_of(spark, sf), elev, 19.0, 50.0, 0.01, 0.0625).select("row", "col", "is_street", "altitude")


@query("R8_add_residential", uses=("fx_cells", "fx_streets"), sql="""
SELECT row, col, coalesce(c.is_street, 0e0) AS is_street, coalesce(c.altitude, 0e0) AS altitude, CASE WHEN s.mark IS NULL THEN 0e0 ELSE 1e0 END AS is_residential
FROM fx_cells c FULL JOIN (SELECT row, col, 1 AS mark FROM fx_streets WHERE is_residential > 0) s USING (row, col)""")
def add_residential(spark, sf):
    return raster.add_residential(cells_of(spark, sf), view(spark, sf, "fx_streets").where("is_residential > 0"))
