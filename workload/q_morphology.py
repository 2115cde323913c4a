"""Morphology and component queries over the growing street raster and the noise raster."""

from pyspark.sql import functions as F

from cobblestone.functions import lattice
from cobblestone.operators import components, morphology
from workload.fixtures import cells_side, view
from workload.registry import query

# --- SQL building blocks -------------------------------------------------------------------------

BLOCK9 = "(VALUES " + ", ".join(f"({i}, {j})" for i, j in lattice.BLOCK) + ") o(di, dj)"
CROSS5 = "(VALUES " + ", ".join(f"({i}, {j})" for i, j in lattice.CROSS) + ") o(di, dj)"
AROUND8 = "(VALUES " + ", ".join(f"({i}, {j})" for i, j in lattice.AROUND) + ") o(di, dj)"
RING8 = "(VALUES " + ", ".join(f"({i}, {j}, {1 << b})" for b, (i, j) in enumerate(morphology.RING)) + ") o(di, dj, bit)"
SIZE = "size AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM fx_streets)"
LAST = "(SELECT side - 1 FROM fx_side)"
NOISE = "img AS (SELECT row, col FROM fx_cells WHERE is_street > 0)"
KEY = "CAST(row AS BIGINT) * 4294967296 + col"


def labels_sql(source: str, name: str = "lab", offsets: str = AROUND8) -> str:
    """Minimum cell key per component, by keyed recursion."""
    return f"""{name}(row, col, label) USING KEY (row, col) AS (
  SELECT row, col, {KEY} FROM {source}
  UNION
  SELECT r.row, r.col, min(l.label) FROM {name} l, {offsets}, recurring.{name} r
  WHERE r.row = l.row + o.di AND r.col = l.col + o.dj AND r.label > l.label GROUP BY r.row, r.col)"""


def thinning_sql(passes: int, pad: int = 5, source: str = "fx_streets", before: tuple[str, ...] = ()) -> str:
    """The framed raster and a fixed number of sub-iterations: skel(row, col); ``before`` defines the source."""
    parts = [SIZE, *before, f"""img0 AS MATERIALIZED (SELECT row, col FROM {source} UNION ALL
  SELECT row, unnest(CASE WHEN row BETWEEN 0 AND h - 1 THEN list_concat(generate_series(-{pad}, -1), generate_series(w, w + {pad - 1})) ELSE generate_series(-{pad}, w + {pad - 1}) END) AS col
  FROM (SELECT h, w, unnest(generate_series(-{pad}, h + {pad - 1})) AS row FROM size) q)"""]
    for k in range(passes):
        keeps = (21, 84) if k % 2 == 0 else (69, 81)
        parts.append(f"""mask{k} AS MATERIALIZED (SELECT row - di AS row, col - dj AS col, bit_or(bit) AS m FROM img{k}, {RING8} GROUP BY 1, 2)""")
        parts.append(f"""img{k + 1} AS MATERIALIZED (SELECT i.row, i.col FROM img{k} i LEFT JOIN (SELECT row, col FROM mask{k} WHERE bit_count(m) BETWEEN 2 AND 6
  AND bit_count(m & ~(((m << 1) | (m >> 7)) & 255)) = 1 AND m & {keeps[0]} <> {keeps[0]} AND m & {keeps[1]} <> {keeps[1]}) d ON d.row = i.row AND d.col = i.col WHERE d.row IS NULL)""")
    parts.append(f"skel AS MATERIALIZED (SELECT row, col FROM img{passes}, size WHERE row BETWEEN 0 AND h - 1 AND col BETWEEN 0 AND w - 1)")
    return ",\n".join(parts)


CROSSROADS_SQL = f"""centres AS (SELECT row, col FROM (SELECT row - di AS row, col - dj AS col, bit_or(bit) AS m FROM skel, {RING8} GROUP BY 1, 2) q, size
  WHERE row BETWEEN 1 AND h - 2 AND col BETWEEN 1 AND w - 2 AND bit_count(m & ~(((m << 1) | (m >> 7)) & 255)) >= 3),
xroads AS MATERIALIZED (SELECT DISTINCT row + di AS row, col + dj AS col FROM centres, {BLOCK9}),
separated AS MATERIALIZED (SELECT s.row, s.col FROM skel s LEFT JOIN xroads x ON x.row = s.row AND x.col = s.col WHERE x.row IS NULL)"""
PASSES = 16  # enough for the thinning of fx_streets to come to rest


def streets_of(spark, sf):
    streets = view(spark, sf, "fx_streets")
    height = streets.agg(F.max("row")).first()[0] + 1
    width = streets.agg(F.max("col")).first()[0] + 1
    return streets, height, width


def noise_of(spark, sf):
    return view(spark, sf, "fx_cells").where("is_street > 0").select("row", "col")


def skeleton_of(spark, sf):
    streets, height, width = streets_of(spark, sf)
    return morphology.skeletonise(streets, height, width), height, width


# --- queries -------------------------------------------------------------------------------------


@query("G1_component_labels_noise", uses=("fx_cells",), sql=f"WITH RECURSIVE {NOISE}, {labels_sql('img')} SELECT row, col, label FROM lab")
def labels_noise(spark, sf):
    return components.label_cells(noise_of(spark, sf), block=64).select("row", "col", "label")


@query("G1_component_labels_streets", uses=("fx_streets",), sql=f"WITH RECURSIVE {labels_sql('fx_streets')} SELECT row, col, label FROM lab")
def labels_streets(spark, sf):
    return components.label_cells(view(spark, sf, "fx_streets").select("row", "col")).select("row", "col", "label")


SMALL = f"""{labels_sql('img', 'lab', '(VALUES (-1, 0), (0, -1), (0, 1), (1, 0)) o(di, dj)')},
kept AS (SELECT row, col FROM lab JOIN (SELECT label FROM lab GROUP BY label HAVING count(*) >= 10) b USING (label))"""


@query("R10_remove_small_objects", uses=("fx_cells",), sql=f"WITH RECURSIVE {NOISE}, {SMALL} SELECT row, col FROM kept")
def remove_small(spark, sf):
    return morphology.remove_small_objects(noise_of(spark, sf))


DILATED = f"""dil AS (SELECT DISTINCT row + di AS row, col + dj AS col FROM img, {CROSS5} WHERE row + di BETWEEN 0 AND {LAST} AND col + dj BETWEEN 0 AND {LAST})"""
CLOSED = DILATED + f""",
closed AS (SELECT row, col FROM (SELECT d.row + di AS row, d.col + dj AS col FROM dil d, {CROSS5}) q WHERE row BETWEEN 0 AND {LAST} AND col BETWEEN 0 AND {LAST} GROUP BY row, col
  HAVING count(*) = 5 - (CASE WHEN row = 0 THEN 1 ELSE 0 END + CASE WHEN row = {LAST} THEN 1 ELSE 0 END + CASE WHEN col = 0 THEN 1 ELSE 0 END + CASE WHEN col = {LAST} THEN 1 ELSE 0 END))"""


@query("R11_binary_closing", uses=("fx_cells",), sql=f"WITH {NOISE}, {CLOSED} SELECT row, col FROM closed")
def closing(spark, sf):
    side = cells_side(spark, sf)
    return morphology.close_cross(noise_of(spark, sf), side, side)


@query("R12_dilate_square", uses=("fx_cells",), sql=f"""WITH {NOISE}, s AS (SELECT unnest(generate_series(-2, 2)) AS d), a AS (SELECT DISTINCT row + d AS row, col FROM img, s),
b AS (SELECT DISTINCT row, col + d AS col FROM a, s) SELECT row, col FROM b WHERE row BETWEEN 0 AND {LAST} AND col BETWEEN 0 AND {LAST}""")
def dilation(spark, sf):
    side = cells_side(spark, sf)
    return morphology.dilate_square(noise_of(spark, sf), side, side, 2)


BORDER = f"""border AS MATERIALIZED (SELECT s.row, s.col FROM fx_streets s JOIN (SELECT row + di AS row, col + dj AS col, count(*) AS n FROM fx_streets, {BLOCK9} GROUP BY 1, 2) c USING (row, col), size
  WHERE n < (CASE WHEN s.row IN (0, h - 1) THEN 2 ELSE 3 END) * (CASE WHEN s.col IN (0, w - 1) THEN 2 ELSE 3 END))"""


@query("R15_border_cells", uses=("fx_streets",), sql=f"WITH {SIZE}, {BORDER} SELECT row, col FROM border")
def border(spark, sf):
    streets, h, w = streets_of(spark, sf)
    return morphology.border_cells(streets, h, w)


@query("R16_border_components", uses=("fx_streets",), sql=f"WITH RECURSIVE {SIZE}, {BORDER}, {labels_sql('border')} SELECT row, col, label FROM lab")
def border_components(spark, sf):
    streets, h, w = streets_of(spark, sf)
    return morphology.border_components(streets, h, w).select("row", "col", "label")


@query("R17_tile_edge_runs", uses=("fx_streets",), sql=f"""
WITH RECURSIVE edge AS (SELECT row, col, CAST(floor(row / 100e0) AS INT) AS tr, CAST(floor(col / 100e0) AS INT) AS tc FROM fx_streets WHERE row % 100 IN (0, 99) OR col % 100 IN (0, 99)),
lab(row, col, tr, tc, label) USING KEY (row, col) AS (SELECT row, col, tr, tc, {KEY} FROM edge UNION
  SELECT r.row, r.col, r.tr, r.tc, min(l.label) FROM lab l, {AROUND8}, recurring.lab r WHERE r.row = l.row + di AND r.col = l.col + dj AND r.tr = l.tr AND r.tc = l.tc AND r.label > l.label GROUP BY ALL)
SELECT row, col, label FROM lab""")
def tile_edge_runs(spark, sf):
    return morphology.touching_tile_edge(view(spark, sf, "fx_streets"), 100, 100).select("row", "col", "label")


@query("R13_thinning_four_passes", uses=("fx_streets",), sql=f"WITH {thinning_sql(4)} SELECT row, col FROM skel")
def thinning_fixed(spark, sf):
    streets, h, w = streets_of(spark, sf)
    return morphology.skeletonise(streets, h, w, tile=200, passes=3, total_passes=4)


@query("R13_skeleton", uses=("fx_streets",), sql=f"WITH {thinning_sql(PASSES)} SELECT row, col FROM skel")
def skeleton(spark, sf):
    return skeleton_of(spark, sf)[0]


@query("R14_crossroad_cells", uses=("fx_streets",), sql=f"WITH {thinning_sql(PASSES)}, {CROSSROADS_SQL} SELECT row, col FROM xroads")
def crossroads(spark, sf):
    skel, h, w = skeleton_of(spark, sf)
    return morphology.crossroad_cells(skel, h, w)


@query("F12_separated_streets", uses=("fx_streets",), sql=f"WITH {thinning_sql(PASSES)}, {CROSSROADS_SQL} SELECT row, col FROM separated")
def separated(spark, sf):
    skel, h, w = skeleton_of(spark, sf)
    return morphology.subtract(skel, morphology.crossroad_cells(skel, h, w))


@query("F13_border_conflicts", uses=("fx_streets",), sql=f"""
WITH RECURSIVE {thinning_sql(PASSES)}, {CROSSROADS_SQL}, {labels_sql('separated')},
touch AS (SELECT DISTINCT label FROM lab, size WHERE row IN (0, h - 1) OR col IN (0, w - 1))
SELECT row, col, t.label IS NOT NULL AS conflicting FROM lab l LEFT JOIN touch t ON t.label = l.label""")
def border_conflicts(spark, sf):
    skel, h, w = skeleton_of(spark, sf)
    labelled = components.label_cells(morphology.subtract(skel, morphology.crossroad_cells(skel, h, w)))
    yes, no = components.split_by_border(labelled, h, w)
    return yes.select("row", "col", F.lit(True).alias("conflicting")).union(no.select("row", "col", F.lit(False)))


@query("A11_component_summary", uses=("fx_streets",), sql=f"""
WITH RECURSIVE {thinning_sql(PASSES)}, {CROSSROADS_SQL}, {labels_sql('xroads')}
SELECT label, count(*) AS size, round(avg(row), 6) AS centre_row, round(avg(col), 6) AS centre_col, CAST(count(*) FILTER (row IN (0, h - 1) OR col IN (0, w - 1)) AS BIGINT) AS border_cells
FROM lab, size GROUP BY label""")
def component_summary(spark, sf):
    skel, h, w = skeleton_of(spark, sf)
    s = components.component_summary(components.label_cells(morphology.crossroad_cells(skel, h, w)), h, w)
    return s.withColumn("centre_row", F.round("centre_row", 6)).withColumn("centre_col", F.round("centre_col", 6))
