"""Sampling, tile planning, inference, training and streaming queries."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cobblestone.operators import evaluation, grids, raster, sampling
from cobblestone.operators.sampling import LCG_INCREMENT as C, LCG_MODULUS as M, LCG_MULTIPLIER as A, SampleShape
from cobblestone.plans import city, inference, training
from cobblestone.session import cut_lineage, scratch_path
from cobblestone.sources import citygrid, growing_logs, tiles as tile_store
from cobblestone.sources.tile_log import TileLog
from cobblestone.streaming import ingest, log_monitor, samples as stream_samples
from workload.fixtures import cells_side, table, view
from workload.q_geometry import projection_sql
from workload.q_network import edges_of
from workload.q_raster import PIECES, SAT, SEGMENTS, _candidates
from workload.registry import query
from workload.sqltext import WIDTHS, dist, radius

SHAPE = SampleShape(size=48, surplus=16)


def draw_sql(salt: int, key: str = "sample_id") -> str:
    return f"(((({key} + {salt * 7919}) % {M} * {A} + {C}) % {M} * {A} + {C}) % {M})"


def between_sql(salt: int, low: str, high: str) -> str:
    return f"CAST({low} + floor({draw_sql(salt)} * greatest({high} - {low} + 1, 1) / {M}e0) AS INT)"


SAMPLES = f"""ids AS (SELECT c_custkey AS sample_id FROM customer),
cuts AS (SELECT sample_id, {between_sql(1, '0', '(side - 69)')} AS y0, {between_sql(2, '0', '(side - 81)')} AS x0, 68 AS h, 80 AS w FROM ids, fx_side),
clips AS (SELECT *, {between_sql(3, '8', '(w - 40)')} AS cx, {between_sql(4, '8', '(h - 40)')} AS cy FROM cuts),
windows AS (SELECT sample_id, y0 + least(CAST(trunc(cy - greatest(least(16, cx, cy, 48), 0) / 2e0) AS INT), h - 48) AS y0, x0 + least(CAST(trunc(cx - greatest(least(16, cx, cy, 48), 0) / 2e0) AS INT), w - 48) AS x0 FROM clips)"""


def grids_of(spark, sf):
    """One grid: the noise raster."""
    return view(spark, sf, "fx_side").select(F.lit("noise").alias("city"), F.lit(0).alias("city_no"), F.col("side").alias("rows"), F.col("side").alias("cols"))


def ids_of(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"))


def windows_of(spark, sf):
    return sampling.sample_windows(sampling.random_cuts(ids_of(spark, sf), grids_of(spark, sf), 68, 80), SHAPE)


@query("M1_random_cuts", uses=("fx_side",), sql=f"WITH {SAMPLES} SELECT sample_id, y0, x0, h, w FROM cuts")
def random_cuts(spark, sf):
    return sampling.random_cuts(ids_of(spark, sf), grids_of(spark, sf), 68, 80).select("sample_id", "y0", "x0", "h", "w")


# the noise raster and the drawn streets as two cities of different size, three cut sizes
SIZES = [(64, 64), (68, 80), (120, 96)]
CITIES_SQL = f"""grids AS (SELECT 'noise' AS city, 0 AS city_no, side AS rows, side AS cols FROM fx_side UNION ALL SELECT 'streets', 1, max(row) + 1, max(col) + 1 FROM fx_streets),
options AS (SELECT *, CAST(rows - h + 1 AS BIGINT) * (cols - w + 1) AS places FROM grids, (VALUES {', '.join(map(str, SIZES))}) s(h, w) WHERE rows >= h AND cols >= w),
ranges AS (SELECT *, CAST(sum(places) OVER (ORDER BY city_no, h, w) AS BIGINT) AS high, CAST(sum(places) OVER () AS BIGINT) AS total FROM options),
drawn AS (SELECT c_custkey AS sample_id, ({draw_sql(5, 'c_custkey')} * {M} + {draw_sql(6, 'c_custkey')}) % (SELECT any_value(total) FROM ranges) AS r FROM customer),
cuts AS (SELECT sample_id, city, {between_sql(1, '0', '(rows - h)')} AS y0, {between_sql(2, '0', '(cols - w)')} AS x0, h, w FROM drawn JOIN ranges ON r >= high - places AND r < high)"""


def two_cities(spark, sf):
    """(grids, cells) of both."""
    streets = view(spark, sf, "fx_streets")
    size = streets.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    grids = grids_of(spark, sf).unionByName(size.select(F.lit("streets").alias("city"), F.lit(1).alias("city_no"), "rows", "cols"))
    cells = [df.select(F.lit(name).alias("city"), "row", "col", "is_street", "altitude", "is_residential") for name, df in (("noise", view(spark, sf, "fx_cells")), ("streets", streets))]
    return grids, cells[0].union(cells[1])


@query("M1_weighted_cuts", uses=("fx_side", "fx_streets"), sql=f"WITH {CITIES_SQL} SELECT sample_id, city, y0, x0, h, w FROM cuts")
def weighted_cuts(spark, sf):
    return sampling.weighted_cuts(ids_of(spark, sf), two_cities(spark, sf)[0], SIZES)


@query("M2_samples_of_many_cities", uses=("fx_side", "fx_streets", "fx_cells"), sql=f"""WITH {CITIES_SQL},
clips AS (SELECT *, {between_sql(3, '8', '(w - 40)')} AS cx, {between_sql(4, '8', '(h - 40)')} AS cy FROM cuts),
windows AS (SELECT sample_id, city, y0 + least(CAST(trunc(cy - greatest(least(16, cx, cy, 48), 0) / 2e0) AS INT), h - 48) AS y0, x0 + least(CAST(trunc(cx - greatest(least(16, cx, cy, 48), 0) / 2e0) AS INT), w - 48) AS x0 FROM clips),
every AS (SELECT 'noise' AS city, row, col, is_street FROM fx_cells UNION ALL SELECT 'streets', row, col, is_street FROM fx_streets),
c AS (SELECT sample_id, CASE WHEN row - y0 BETWEEN 8 AND 39 AND col - x0 BETWEEN 8 AND 39 THEN 1 ELSE 0 END AS hid, is_street FROM windows w JOIN every e ON e.city = w.city AND row >= y0 AND row < y0 + 48 AND col >= x0 AND col < x0 + 48),
s AS (SELECT sample_id, sum(CASE WHEN hid = 1 THEN 0 ELSE is_street END) AS xs, sum(CASE WHEN hid = 1 THEN is_street ELSE 0 END) AS ys FROM c GROUP BY sample_id)
SELECT w.sample_id, w.sample_id // 8 AS batch_id, 48 * 48 * 2 AS x_size, 32 * 32 AS y_size, 1024 + coalesce(xs, 0) AS x_sum, coalesce(ys, 0) AS y_sum FROM windows w LEFT JOIN s USING (sample_id)""")
def samples_of_many_cities(spark, sf):
    grids, cells = two_cities(spark, sf)
    windows = sampling.sample_windows(sampling.weighted_cuts(ids_of(spark, sf), grids, SIZES), ARRAY_SHAPE)
    return array_summary(sampling.sample_arrays(windows, cells, ARRAY_SHAPE))


@query("M2_sample_windows", uses=("fx_side",), sql=f"WITH {SAMPLES} SELECT sample_id, y0, x0 FROM windows")
def sample_windows(spark, sf):
    return windows_of(spark, sf).select("sample_id", "y0", "x0")


@query("M2_F8_F10_sample_cells", uses=("fx_cells",), sql=f"""WITH {SAMPLES},
c AS (SELECT sample_id, row - y0 AS row, col - x0 AS col, is_street, altitude, is_residential FROM windows JOIN fx_cells ON row >= y0 AND row < y0 + 48 AND col >= x0 AND col < x0 + 48),
places AS (SELECT sample_id, row, unnest(generate_series(0, 47)) AS col FROM (SELECT sample_id, unnest(generate_series(0, 47)) AS row FROM windows) p),
h AS (SELECT p.*, coalesce(is_street, 0) AS is_street, coalesce(altitude, 0) AS altitude, coalesce(is_residential, 0) AS is_residential, c.row IS NOT NULL AS there, CASE WHEN p.row BETWEEN 8 AND 39 AND p.col BETWEEN 8 AND 39 THEN 1 ELSE 0 END AS hid
  FROM places p LEFT JOIN c USING (sample_id, row, col)),
m AS (SELECT * FROM h WHERE there OR hid = 1)
SELECT sample_id, CAST(sum(hid) AS BIGINT) AS hidden, count(*) AS cells, sum(CASE WHEN hid = 1 THEN 0 ELSE is_street END) AS x_street, sum(CASE WHEN hid = 1 THEN 0 ELSE is_residential END) AS x_residential, round(sum(altitude), 2) AS x_altitude,
  sum(CASE WHEN hid = 1 THEN is_street END) AS y_street, round(sum(CASE WHEN hid = 1 THEN altitude END), 2) AS y_altitude, sum(CASE WHEN hid = 1 THEN is_residential END) AS y_residential FROM m GROUP BY sample_id""")
def sample_cells(spark, sf):
    s = sampling.sample_cells(windows_of(spark, sf), view(spark, sf, "fx_cells"), SHAPE)
    return s.groupBy("sample_id").agg(
        F.sum("is_predicted").alias("hidden"), F.count("*").alias("cells"), F.sum("is_street").alias("x_street"), F.sum("is_residential").alias("x_residential"),
        F.round(F.sum("altitude"), 2).alias("x_altitude"), F.sum("y_is_street").alias("y_street"), F.round(F.sum("y_altitude"), 2).alias("y_altitude"), F.sum("y_is_residential").alias("y_residential"))


ARRAYS_SQL = f"""WITH {SAMPLES},
c AS (SELECT sample_id, row - y0 AS row, col - x0 AS col, is_street FROM windows JOIN fx_cells ON row >= y0 AND row < y0 + 48 AND col >= x0 AND col < x0 + 48),
m AS (SELECT sample_id, CASE WHEN row BETWEEN 8 AND 39 AND col BETWEEN 8 AND 39 THEN 1 ELSE 0 END AS hid, is_street FROM c),
s AS (SELECT sample_id, sum(CASE WHEN hid = 1 THEN 0 ELSE is_street END) AS xs, sum(CASE WHEN hid = 1 THEN is_street ELSE 0 END) AS ys FROM m GROUP BY sample_id)
SELECT w.sample_id, w.sample_id // 8 AS batch_id, 48 * 48 * 2 AS x_size, 32 * 32 AS y_size, 1024 + coalesce(xs, 0) AS x_sum, coalesce(ys, 0) AS y_sum FROM windows w LEFT JOIN s USING (sample_id)"""
ARRAY_SHAPE = SampleShape(size=48, surplus=16, inputs=2, outputs=1)


def array_summary(samples_df):
    s = sampling.with_batches(samples_df, 8)

    def summary(batches):
        for batch in batches:
            arrays = [grids.values_of(batch.column(c)) for c in ("x", "y_is_street")]
            sizes = [pa.array([len(v) for v in a], pa.int32()) for a in arrays]
            sums = [pa.array([v.sum(dtype=np.float64) for v in a], pa.float64()) for a in arrays]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("batch_id"), *sizes, *sums], ["sample_id", "batch_id", "x_size", "y_size", "x_sum", "y_sum"])

    return s.select("sample_id", "batch_id", "x", "y_is_street").mapInArrow(summary, "sample_id bigint, batch_id bigint, x_size int, y_size int, x_sum double, y_sum double")


@query("M2_M3_sample_arrays", uses=("fx_cells",), sql=ARRAYS_SQL)
def sample_arrays(spark, sf):
    windows = sampling.sample_windows(sampling.random_cuts(ids_of(spark, sf), grids_of(spark, sf), 68, 80), ARRAY_SHAPE)
    return array_summary(sampling.sample_arrays(windows, view(spark, sf, "fx_cells"), ARRAY_SHAPE))


@query("T3_streamed_samples", uses=("fx_cells",), sql=ARRAYS_SQL)
def streamed_samples(spark, sf):
    arriving, store = scratch_path(spark, "sample-ids"), scratch_path(spark, "streamed-samples")
    ids = ids_of(spark, sf)
    ids.repartition(6, "sample_id").write.parquet(arriving)
    stream = spark.readStream.schema(ids.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    stream_samples.generate(
        stream, grids_of(spark, sf), view(spark, sf, "fx_cells"), ARRAY_SHAPE, (68, 80), store, scratch_path(spark, "sample-state"), endless=False
    ).awaitTermination()
    return array_summary(spark.read.parquet(store))


@query("F9_restore_known", uses=("fx_cells", "fx_streets"), sql="""
SELECT s.row, s.col, CASE WHEN c.hid = 0 THEN c.is_street ELSE s.is_street END AS is_street, CASE WHEN c.hid = 0 THEN c.altitude ELSE s.altitude END AS altitude, CASE WHEN c.hid = 0 THEN c.is_residential ELSE s.is_residential END AS is_residential
FROM fx_streets s LEFT JOIN (SELECT *, (row + col) % 2 AS hid FROM fx_cells) c USING (row, col)""")
def restore_known(spark, sf):
    inputs = view(spark, sf, "fx_cells").withColumn("is_predicted", (F.col("row") + F.col("col")) % 2)
    return sampling.restore_known(inputs, view(spark, sf, "fx_streets"))


@query("M7_city_split", sql=f"""
WITH c AS (SELECT c_custkey AS sample_id, c_name AS city FROM customer) SELECT city, CASE WHEN {draw_sql(11)} < {int(0.2 * M)} THEN 'validation' ELSE 'train' END AS split FROM c""")
def city_split(spark, sf):
    cities = table(spark, sf, "customer").select(F.col("c_custkey").alias("city_no"), F.col("c_name").alias("city"))
    return sampling.split_cities(cities).select("city", "split")


@query("M7_pick_cities", sql=f"""
WITH c AS (SELECT c_custkey AS sample_id, c_name AS city FROM customer) SELECT city FROM c ORDER BY {draw_sql(12)}, sample_id LIMIT 25""")
def pick_cities(spark, sf):
    cities = table(spark, sf, "customer").select(F.col("c_custkey").alias("city_no"), F.col("c_name").alias("city"))
    return sampling.pick_cities(cities, 25).select("city")


# --- tile plan, inference, training --------------------------------------------------------------

PLAN_SHAPE = SampleShape(size=40, surplus=16)


@query("M4_tile_plan", uses=("fx_streets",), sql="""
WITH d AS (SELECT max(row) + 1 - 16 AS oh, max(col) + 1 - 16 AS ow FROM fx_streets), n AS (SELECT *, CAST(ceil(oh / 24e0) AS INT) AS nr, CAST(ceil(ow / 24e0) AS INT) AS nc FROM d),
t AS (SELECT *, unnest(generate_series(0, nc - 1)) AS c FROM (SELECT *, unnest(generate_series(0, nr - 1)) AS r FROM n) q)
SELECT r, c, least(r * 24, oh - 24) AS y0, least(c * 24, ow - 24) AS x0, c + 2 * r AS wave FROM t""")
def tile_plan(spark, sf):
    s = view(spark, sf, "fx_streets").agg(F.max("row"), F.max("col")).first()
    return inference.tile_plan(spark, s[0] + 1, s[1] + 1, PLAN_SHAPE).select("r", "c", "y0", "x0", "wave")


@query("M4_tile_dependencies", uses=("fx_streets",), sql="""
WITH d AS (SELECT max(row) + 1 - 16 AS oh, max(col) + 1 - 16 AS ow FROM fx_streets), n AS (SELECT *, CAST(ceil(oh / 24e0) AS INT) AS nr, CAST(ceil(ow / 24e0) AS INT) AS nc FROM d),
t AS (SELECT *, unnest(generate_series(0, nc - 1)) AS c FROM (SELECT *, unnest(generate_series(0, nr - 1)) AS r FROM n) q),
p AS (SELECT r, c, least(r * 24, oh - 24) AS y, least(c * 24, ow - 24) AS x FROM t)
SELECT a.r, a.c, b.r AS need_r, b.c AS need_c, true AS earlier_wave FROM p a JOIN p b ON (b.y < a.y AND b.y + 24 > a.y - 8 AND b.x < a.x + 32 AND b.x + 24 > a.x - 8 AND (b.r, b.c) < (a.r, a.c))
  OR (b.x < a.x AND b.x + 24 > a.x - 8 AND b.y < a.y + 24 AND b.y + 24 > a.y AND (b.r, b.c) < (a.r, a.c))""")
def tile_dependencies(spark, sf):
    s = view(spark, sf, "fx_streets").agg(F.max("row"), F.max("col")).first()
    plan = inference.tile_plan(spark, s[0] + 1, s[1] + 1, PLAN_SHAPE)
    deps = inference.tile_dependencies(plan, s[0] + 1, s[1] + 1, PLAN_SHAPE)
    return deps.select("r", "c", "need_r", "need_c", (F.col("need_wave") < F.col("wave")).alias("earlier_wave"))


# one shape at every scale; a raster smaller than a tile is refused
TILE_SHAPE = SampleShape(size=160, surplus=32)


def masked_streets(spark, sf):
    streets = view(spark, sf, "fx_streets")
    s = streets.agg(F.max("row"), F.max("col")).first()
    return streets, s[0] + 1, s[1] + 1


@query("M6_tiled_inference")
def tiled_inference(spark, sf):
    cells, rows, cols = masked_streets(spark, sf)
    out = inference.predict(cells, rows, cols, TILE_SHAPE, lambda r, c: F.floor(r / 40) % 2 == 1)
    return out.groupBy(F.floor(F.col("row") / 50).alias("band"), F.floor(F.col("col") / 50).alias("column")).agg(
        F.count("*").alias("cells"), F.sum("is_street").alias("street_cells"), F.round(F.avg("altitude"), 4).alias("altitude"))


#: Every position of the raster, its value and what M6 and M8 leave of it around the hidden region ``{hidden}``.
CARRY = """extent AS (SELECT CAST(max(row) + 1 AS INT) AS h, CAST(max(col) + 1 AS INT) AS w FROM fx_streets),
place AS (SELECT row, unnest(generate_series(0, w - 1)) AS col, h, w FROM (SELECT unnest(generate_series(0, h - 1)) AS row, h, w FROM extent) q),
seen AS (SELECT p.row, p.col, p.h, p.w, coalesce(s.is_street, 0) AS is_street, coalesce(s.altitude, 0) AS altitude, {hidden} AS hidden, p.col BETWEEN 16 AND p.w - 17 AS central
  FROM place p LEFT JOIN fx_streets s ON s.row = p.row AND s.col = p.col),
carried AS (SELECT row, col, h, w, is_street AS y_is_street,
  last_value(CASE WHEN NOT hidden THEN is_street WHEN NOT central THEN 0 END IGNORE NULLS) OVER along AS is_street,
  last_value(CASE WHEN NOT (hidden AND central) THEN altitude END IGNORE NULLS) OVER along AS altitude
  FROM seen WINDOW along AS (PARTITION BY row ORDER BY col ROWS UNBOUNDED PRECEDING)),
done AS (SELECT row - 16 AS row, col - 16 AS col, y_is_street, is_street, altitude FROM carried WHERE row BETWEEN 16 AND h - 17 AND col BETWEEN 16 AND w - 17)"""
CHECKERED = CARRY.format(hidden="(p.row // 40 + p.col // 56) % 2 = 1")
FRAGMENT = CARRY.format(hidden="p.row BETWEEN 16 AND p.h - 17 AND p.col BETWEEN 16 AND p.w - 17")


@query("M6_U1_carried_inference", uses=("fx_streets",), sql=f"WITH {CHECKERED} SELECT row, col, is_street, round(altitude, 2) AS altitude FROM done")
def carried_inference(spark, sf):
    cells, rows, cols = masked_streets(spark, sf)
    out = inference.predict(cells, rows, cols, TILE_SHAPE, lambda r, c: (F.floor(r / 40) + F.floor(c / 56)) % 2 == 1, "row_carry")
    return out.select("row", "col", "is_street", F.round("altitude", 2).alias("altitude"))


@query("M8_carried_fragment", uses=("fx_streets",), sql=f"""WITH {FRAGMENT} SELECT row, col, y_is_street, is_street AS p_is_street FROM done""")
def carried_fragment(spark, sf):
    cells, rows, cols = masked_streets(spark, sf)
    both = inference.predict_fragment(cells, 0, 0, rows, cols, rows, cols, TILE_SHAPE, "row_carry")
    return both.select("row", "col", "y_is_street", "p_is_street")


@query("M8_evaluation_fragment")
def evaluation_fragment(spark, sf):
    cells, rows, cols = masked_streets(spark, sf)
    both = inference.predict_fragment(cells, 0, 0, rows, cols, rows, cols, TILE_SHAPE)
    report = evaluation.binary_report(both.withColumn("run", F.lit("fragment")), "y_is_street", "p_is_street", "run")
    return report.select("run", *[F.round(c, 6).alias(c) for c in report.columns[1:]])


# bands of 128 rows of the drawn streets as cities
BAND_SHAPE = SampleShape(size=48, surplus=16)
BANDS = f"""bands AS (SELECT concat('band', n) AS city, n AS city_no, least(128, h - n * 128) AS rows, w AS cols FROM (SELECT unnest(generate_series(0, (h - 48) // 128)) AS n, h, w FROM (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM fx_streets) s) q WHERE h - n * 128 >= 48),
options AS (SELECT *, CAST(rows - 47 AS BIGINT) * (cols - 47) AS places FROM bands),
ranges AS (SELECT *, CAST(sum(places) OVER (ORDER BY city_no) AS BIGINT) AS high, CAST(sum(places) OVER () AS BIGINT) AS total FROM options),
drawn AS (SELECT s_suppkey AS sample_id, ({draw_sql(5, 's_suppkey')} * {M} + {draw_sql(6, 's_suppkey')}) % (SELECT any_value(total) FROM ranges) AS r FROM supplier),
cuts AS (SELECT sample_id, city, city_no, {between_sql(1, '0', '(rows - 48)')} AS y0, {between_sql(2, '0', '(cols - 48)')} AS x0 FROM drawn JOIN ranges ON r >= high - places AND r < high),
clips AS (SELECT *, {between_sql(3, '8', '8')} AS cx, {between_sql(4, '8', '8')} AS cy FROM cuts),
windows AS (SELECT sample_id, city_no, y0 + least(CAST(trunc(cy - greatest(least(16, cx, cy, 48), 0) / 2e0) AS INT), 0) AS y0, x0 + least(CAST(trunc(cx - greatest(least(16, cx, cy, 48), 0) / 2e0) AS INT), 0) AS x0 FROM clips)"""


def banded(spark, sf):
    """(cities, windows, features) of the bands."""
    cells = view(spark, sf, "fx_streets")
    size = cells.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    band = F.floor(F.col("row") / 128).cast("int")
    cities = size.select("h", "w", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 48) / 128).cast("int"))).alias("city_no")).where("h - city_no * 128 >= 48")
    cities = cities.select(F.concat(F.lit("band"), "city_no").alias("city"), "city_no", F.least(F.lit(128), F.col("h") - F.col("city_no") * 128).alias("rows"), F.col("w").alias("cols"))
    own = cells.select(F.concat(F.lit("band"), band).alias("city"), (F.col("row") % 128).alias("row"), "col", "is_street", "altitude", "is_residential")
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    windows = cut_lineage(sampling.sample_windows(sampling.weighted_cuts(ids, cities, [(48, 48)]), BAND_SHAPE), "m5-windows")
    samples = cut_lineage(sampling.sample_cells(windows, own, BAND_SHAPE), "m5-samples")
    return cities, windows, cut_lineage(training.border_features(samples, windows, BAND_SHAPE), "m5-features")


@query("M5_border_features", uses=("fx_streets",), sql=f"""WITH {BANDS},
street AS (SELECT row // 128 AS city_no, row % 128 AS row, col FROM fx_streets WHERE is_street > 0),
seen AS (SELECT sample_id, s.row - y0 AS row, s.col - x0 AS col FROM windows w JOIN street s ON s.city_no = w.city_no AND s.row BETWEEN y0 AND y0 + 47 AND s.col BETWEEN x0 AND x0 + 47),
known AS (SELECT * FROM seen WHERE NOT (row BETWEEN 8 AND 39 AND col BETWEEN 8 AND 39)),
by_row AS (SELECT sample_id, row, max(CASE WHEN col = 7 THEN 1e0 ELSE 0e0 END) AS "left", max(CASE WHEN col = 40 THEN 1e0 ELSE 0e0 END) AS "right", CAST(count(*) AS DOUBLE) AS row_known FROM known GROUP BY 1, 2),
by_col AS (SELECT sample_id, col, max(CASE WHEN row = 7 THEN 1e0 ELSE 0e0 END) AS above, max(CASE WHEN row = 40 THEN 1e0 ELSE 0e0 END) AS below, CAST(count(*) AS DOUBLE) AS col_known FROM known GROUP BY 1, 2),
hidden AS (SELECT sample_id, row, unnest(generate_series(8, 39)) AS col FROM (SELECT sample_id, unnest(generate_series(8, 39)) AS row FROM windows) p)
SELECT h.sample_id, h.row, h.col, CASE WHEN s.row IS NULL THEN 0e0 ELSE 1e0 END AS label, coalesce("left", 0) AS "left", coalesce("right", 0) AS "right", coalesce(above, 0) AS above, coalesce(below, 0) AS below,
  coalesce(row_known, 0) AS row_known, coalesce(col_known, 0) AS col_known, CAST(least(h.row - 8, 39 - h.row, h.col - 8, 39 - h.col) AS DOUBLE) AS depth
FROM hidden h LEFT JOIN seen s USING (sample_id, row, col) LEFT JOIN by_row r ON r.sample_id = h.sample_id AND r.row = h.row LEFT JOIN by_col c ON c.sample_id = h.sample_id AND c.col = h.col""")
def border_features(spark, sf):
    return banded(spark, sf)[2].select("sample_id", "row", "col", "label", *training.FEATURES)


def fitted(spark, sf):
    """The model of the cities that are not held out (one in four is), and its validation rows."""
    cities, windows, features = banded(spark, sf)
    held_out = sampling.pick_cities(cities, max(1, cities.count() // 4))
    train, validation = training.by_city(features, windows, held_out)
    return training.fit(train), validation


@query("M5_training_baseline")
def training_baseline(spark, sf):
    model, validation = fitted(spark, sf)
    report = training.evaluate(model, validation)
    return report.select("run", *[F.round(c, 4).alias(c) for c in report.columns[1:]])


@query("M6_fitted_inference")
def fitted_inference(spark, sf):
    """Inference with the fitted model: cells and street cells by parts of the raster."""
    model = training.StreetModel.of(fitted(spark, sf)[0])
    cells, rows, cols = masked_streets(spark, sf)
    out = inference.predict(cells, rows, cols, TILE_SHAPE, lambda r, c: (F.floor(r / 40) + F.floor(c / 56)) % 2 == 1, model)
    return out.groupBy(F.floor(F.col("row") / 50).alias("band"), F.floor(F.col("col") / 50).alias("column")).agg(
        F.count("*").alias("cells"), F.sum("is_street").alias("street_cells"))


# --- grid files, tile store, city plans, streams -------------------------------------------------


def grid_file(spark, sf):
    side = cells_side(spark, sf)
    tiles = raster.dense_tiles(view(spark, sf, "fx_cells"), side, side, 150, 200)
    path = scratch_path(spark, "grids").removeprefix("file:") + "/noise.grid_city"
    citygrid.register(spark)
    options = {"rows": side, "cols": side, "segment_h": 150, "segment_w": 200}
    tiles.write.format("citygrid").options(**options).mode("append").save(path)
    return path


@query("S1_S4_grid_file_round_trip", uses=("fx_cells",), sql="SELECT CAST(floor(row / 150e0) AS INT) AS seg_row, CAST(floor(col / 200e0) AS INT) AS seg_col, row, col, CAST(altitude AS FLOAT) AS altitude FROM fx_cells WHERE altitude <> 0")
def grid_file_round_trip(spark, sf):
    path = grid_file(spark, sf)
    return spark.read.format("citygrid").load(path).where("altitude <> 0").select("seg_row", "seg_col", "row", "col", "altitude")


@query("S1_segment_read", uses=("fx_cells",), sql="SELECT row, col, is_street, is_residential FROM fx_cells WHERE row BETWEEN 150 AND 299 AND col < 200 AND altitude <> 0")
def segment_read(spark, sf):
    cells = spark.read.format("citygrid").load(grid_file(spark, sf)).where("seg_row = 1 AND seg_col = 0 AND altitude <> 0")
    return cells.select("row", "col", F.col("is_street").cast("double").alias("is_street"), F.col("is_residential").cast("double").alias("is_residential"))


@query("S4_tile_store", uses=("fx_cells", "fx_streets"), sql="""
SELECT row, col, is_street FROM fx_cells WHERE is_street > 0 AND NOT (row < 150 AND col < 200) UNION ALL SELECT row, col, is_street FROM fx_streets WHERE row < 150 AND col < 200""")
def tile_store_rewrite(spark, sf):
    path = scratch_path(spark, "tiles")
    side = cells_side(spark, sf)
    tiles = raster.dense_tiles(view(spark, sf, "fx_cells"), side, side, 150, 200).withColumn("city", F.lit("noise"))
    tile_store.write_tiles(tiles, path)
    corner = raster.read_window(view(spark, sf, "fx_streets"), 0, 0, 150, 200, 150, 200)
    tile_store.write_tiles(raster.dense_tiles(corner, 150, 200, 150, 200).withColumn("city", F.lit("noise")), path)
    back = tile_store.read_tiles(spark, path, "noise")
    return raster.tile_cells(back, 150, 200).where("is_street > 0").select("row", "col", F.col("is_street").cast("double").alias("is_street"))


def geographic_network(spark, sf):
    nodes = view(spark, sf, "fx_nodes").select("node_id", (19 + F.col("x") / 71500.0).alias("x"), (50 + F.col("y") / 111300.0).alias("y"))
    return nodes, edges_of(spark, sf)


GEO = ("(19 + x / CAST(71500 AS DOUBLE))", "(50 + y / CAST(111300 AS DOUBLE))")
_turn_radius = radius(dist("a.x", "a.y", "b.x", "b.y"), dist("b.x", "b.y", "c.x", "c.y"), dist("c.x", "c.y", "a.x", "a.y"), "1e-4", "0")
# a lattice street has one way on per node, so its straightest turn is its only one
RESIDENTIAL = f"""metric AS ({projection_sql(32634, *GEO)}),
turn AS (SELECT e.u, e.v, e.name, {_turn_radius} AS r FROM fx_edges e JOIN fx_edges f ON f.u = e.v AND f.name = e.name AND f.v <> e.u
  JOIN metric a ON a.node_id = e.u JOIN metric b ON b.node_id = e.v JOIN metric c ON c.node_id = f.v),
street_radius AS (SELECT name, min(r) AS r FROM turn GROUP BY name),
res AS (SELECT e.u, e.v, e.highway = 'residential' AND coalesce(s.r, CAST('Infinity' AS DOUBLE)) < 30 AS is_residential FROM fx_edges e LEFT JOIN street_radius s ON s.name = e.name)"""


@query("G8_city_roads", uses=("fx_nodes", "fx_edges"), sql=f"""WITH {WIDTHS}, {RESIDENTIAL}
SELECT w.u, w.v, w.k, round(2 * 6371009.0 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 1.0))), 3) AS length_m,
  round(width_m, 3) AS width_m, is_residential, CASE WHEN width_m IS NULL THEN NULL ELSE 4 END AS corners
FROM widths w JOIN res USING (u, v) JOIN metric a ON a.node_id = w.u JOIN metric b ON b.node_id = w.v""")
def city_roads(spark, sf):
    nodes, edges = geographic_network(spark, sf)
    roads = city.city_roads(nodes, edges)
    return roads.select("u", "v", "k", F.round("length_m", 3).alias("length_m"), F.round("width_m", 3).alias("width_m"), "is_residential", F.size("ring").alias("corners"))


@query("R6_city_grid", uses=("fx_nodes", "fx_edges"), sql=f"""WITH national AS ({projection_sql(2180, *GEO)}), {RESIDENTIAL}, {PIECES.replace('fx_nodes', 'national')}, {SEGMENTS.replace('least(400', 'least(500')}, {_candidates(2.0, 'framed')}
SELECT seg_row * 500 + row AS row, seg_col * 500 + col AS col, 1e0 AS is_street, 0e0 AS altitude, CAST(max(CASE WHEN is_residential THEN 1 ELSE 0 END) AS DOUBLE) AS is_residential
FROM boxes JOIN res USING (u, v) WHERE {SAT} GROUP BY 1, 2""")
def city_grid(spark, sf):
    nodes, edges = geographic_network(spark, sf)
    roads = cut_lineage(city.city_roads(nodes, edges), "city-roads")
    return city.city_grid(roads, 500, 500, 2.0)


# the log as one file per 1,000 lines; a file belongs to the run that wrote it
LOG_METRICS = """WITH marked AS (SELECT line_no, value, line_no // 1000 AS run, last_value(CASE WHEN regexp_matches(value, 'performing ([0-9]+)-th epoch') THEN CAST(regexp_extract(value, 'performing ([0-9]+)-th epoch', 1) AS INT) END IGNORE NULLS) OVER (PARTITION BY line_no // 1000 ORDER BY line_no) AS epoch FROM fx_log),
hits AS (SELECT run, line_no, epoch, unnest(regexp_extract_all(value, '(val_)?is_street[_\\w]*:\\s*([0-9.eE+-]+)', 0)) AS m FROM marked WHERE epoch IS NOT NULL),
x AS (SELECT run, line_no, epoch, trim(split_part(m, ':', 1)) AS metric, CAST(trim(split_part(m, ':', 2)) AS DOUBLE) AS value FROM hits)"""


def whole_logs(spark, sf):
    """(run, text): the log of every run as it will be in the end."""
    runs = view(spark, sf, "fx_log").withColumn("run", F.floor(F.col("line_no") / 1000))
    lines = F.array_sort(F.collect_list(F.struct("line_no", F.concat("value", F.lit("\n")).alias("line"))))
    runs = runs.repartition(2 * spark.sparkContext.defaultParallelism, "run")  # few bytes, but a file to write for every run
    return cut_lineage(runs.groupBy("run").agg(F.array_join(lines["line"], "").alias("text")), "whole-logs")


def deliver(logs, folder, share):
    """Writes the first ``share`` of the bytes of every run's log, as a trainer would have by then; again for more."""

    def write(batches):
        store, root = growing_logs.open_store(folder)
        store.create_dir(root)
        for pdf in batches:
            for run, text in zip(pdf["run"], pdf["text"]):
                text = text.encode()
                part = text[: int(len(text) * (share if run % 3 else max(0, 2 * share - 1)))]  # some runs begin later
                if part:
                    with store.open_output_stream(f"{root}/{run}.log") as file:
                        file.write(part)
            yield pdf[["run"]]

    logs.mapInPandas(write, "run bigint").write.format("noop").mode("overwrite").save()


def watched(spark, sf):
    """The stored results of a monitor that was started three times while the logs grew, lines cut anywhere."""
    folder, store, state = (scratch_path(spark, x) for x in ("growing-logs", "monitor", "monitor-state"))
    logs = whole_logs(spark, sf)
    for share in (0.37, 0.71, 1.0):
        deliver(logs, folder, share)
        log_monitor.monitor(log_monitor.log_stream(spark, folder, piece_bytes=4096), store, state).awaitTermination()
    return store


def run_of_file():
    return F.regexp_extract("run", "([0-9]+)[.]log$", 1).cast("bigint").alias("run")


@query("T1_live_log_monitor", uses=("fx_log",), sql=LOG_METRICS + """
SELECT run, metric, epoch AS best_epoch, value AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY value DESC, line_no) AS rn FROM x) q WHERE rn = 1""")
def live_log_monitor(spark, sf):
    return log_monitor.best_so_far(spark, watched(spark, sf)).withColumn("run", run_of_file())


@query("T1_metrics_of_growing_logs", uses=("fx_log",), sql=LOG_METRICS + """,
b AS (SELECT *, max(value) OVER w AS best_value FROM x WINDOW w AS (PARTITION BY run, metric ORDER BY line_no))
SELECT run, epoch, metric, value, best_value, first_value(epoch) OVER (PARTITION BY run, metric, best_value ORDER BY line_no) AS best_epoch FROM b""")
def metrics_of_growing_logs(spark, sf):
    return log_monitor.metrics_so_far(spark, watched(spark, sf)).select(run_of_file(), "epoch", "metric", "value", "best_value", "best_epoch")


def arrivals(spark, sf):
    """Tiles of the noise raster in four deliveries, each segment twice: of even segments the version with doubled altitude
    arrives last, of odd ones first (its delivery may still come later)."""
    side = cells_side(spark, sf)
    tiles = raster.dense_tiles(view(spark, sf, "fx_cells"), side, side, 150, 200).withColumn("city", F.lit("noise"))
    even = (F.col("seg_row") + F.col("seg_col")) % 2 == 0
    number = F.col("seg_row") * -(-side // 200) + F.col("seg_col")
    # channels are interleaved, altitude is the second of three
    doubled = tiles.withColumn("data", F.transform("data", lambda v, i: F.when(i % 3 == 1, 2 * v).otherwise(v)))
    first = tiles.withColumns({"arrived": number + 1000, "delivery": number % 4})
    second = doubled.withColumns({"arrived": F.when(even, number + 5000).otherwise(number), "delivery": (number + 1) % 4})
    return cut_lineage(first.unionByName(second).withColumn("arrived", F.col("arrived").cast("bigint")), "arrivals", **tile_store.TILE_FILES), side


def ingested(spark, sf):
    """The store after all deliveries, a batch each; every second batch writes the state."""
    tiles, side = arrivals(spark, sf)
    folder, store = scratch_path(spark, "arriving"), scratch_path(spark, "ingested")
    schema = tiles.drop("delivery").schema
    segments = -(-side // 150) * -(-side // 200)
    state = scratch_path(spark, "ingest-state")
    for d in range(4):  # the ingest is started after each delivery and takes what is new, however many files that is
        tiles.where(F.col("delivery") == d).drop("delivery").write.mode("append").options(**tile_store.TILE_FILES).parquet(folder)
        ingest.ingest(ingest.tile_stream(spark, folder, schema, max_files=1_000_000), store, state, segments, every=2).awaitTermination()
    return store, schema


SEGMENT = "(row // 150) * ((side - 1) // 200 + 1) + col // 200"


@query("T2_segment_ingest", uses=("fx_cells", "fx_side"), sql="""
SELECT row // 150 AS seg_row, col // 200 AS seg_col, CAST(count(*) AS BIGINT) AS street_cells, round(sum(CAST(CAST(altitude AS FLOAT) AS DOUBLE)) * CASE WHEN (row // 150 + col // 200) % 2 = 0 THEN 2 ELSE 1 END, 2) AS altitude
FROM fx_cells WHERE is_street > 0 GROUP BY row // 150, col // 200""")
def segment_ingest(spark, sf):
    store, schema = ingested(spark, sf)
    cells = raster.tile_cells(TileLog(spark, store, every=2).tiles(schema).drop("arrived"), 150, 200).where("is_street > 0")
    return cells.groupBy(F.floor(F.col("row") / 150).alias("seg_row"), F.floor(F.col("col") / 200).alias("seg_col")).agg(
        F.count("*").alias("street_cells"), F.round(F.sum("altitude"), 2).alias("altitude"))


@query("T2_U3_ingest_progress", uses=("fx_side",), sql="""
WITH segs AS (SELECT r * nc + c AS number, (r + c) % 2 AS odd, nr * nc AS total FROM (
  SELECT unnest(range((side - 1) // 150 + 1)) AS r, (side - 1) // 150 + 1 AS nr, (side - 1) // 200 + 1 AS nc FROM fx_side) a, LATERAL (SELECT unnest(range(nc)) AS c) b),
tiles AS (SELECT number, total, number + 1000 AS arrived, number % 4 AS batch FROM segs
  UNION ALL SELECT number, total, CASE WHEN odd = 0 THEN number + 5000 ELSE number END, (number + 1) % 4 FROM segs),
firsts AS (SELECT number, min(batch) AS f FROM tiles GROUP BY number)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS tiles, CAST(max(arrived) AS BIGINT) AS last_arrival, CAST(count(*) FILTER (f = batch) AS BIGINT) AS added,
  CAST(sum(count(*) FILTER (f = batch)) OVER (ORDER BY batch) AS BIGINT) AS done, sum(count(*) FILTER (f = batch)) OVER (ORDER BY batch) / CAST(max(total) AS DOUBLE) AS share
FROM tiles JOIN firsts USING (number) GROUP BY batch""")
def ingest_progress(spark, sf):
    store, _ = ingested(spark, sf)
    return ingest.progress(spark, store).select("batch", "tiles", "last_arrival", "added", "done", "share")
