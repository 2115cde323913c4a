"""Findings of round 4: memory, disk and time that grew with the tables."""

import pathlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cobblestone.operators import grids, sampling
from cobblestone.plans import city_store
from cobblestone.sources.tile_log import TileLog


def row_groups(folder):
    """Rows of every row group below a folder."""
    files = [pq.ParquetFile(f).metadata for f in pathlib.Path(folder).rglob("*.parquet")]
    return [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]


def test_stored_city_tiles_are_read_a_few_at_once(spark, tmp_path):
    """4,096 tiles of equal values are a small file, but not small arrays."""
    meta = spark.createDataFrame([("c", 200, 40, 500000.0, 5500000.0, 2.0, 4, 10, 32634)], city_store.META)
    tiles = spark.range(200).select(
        F.lit("c").alias("city"), (F.col("id") % 50).cast("int").alias("seg_row"), F.floor(F.col("id") / 50).cast("int").alias("seg_col"),
        F.lit(4).alias("h"), F.lit(10).alias("w"), F.lit(3).alias("channels"), F.array_repeat(F.lit(1.0).cast("float"), 120).alias("data"))
    city_store.write_store(meta, tiles.coalesce(1), str(tmp_path))
    assert sum(row_groups(tmp_path / "tiles")) == 200 and max(row_groups(tmp_path / "tiles")) <= 8
    assert city_store.read_store(spark, str(tmp_path))[1].where("size(data) = 120").count() == 200


def test_places_between_knots_are_those_of_every_cell():
    """Conformal maps bend as much one way along rows as the other way along columns, which cancels in the middle of a square."""
    rng = np.random.default_rng(1)
    for k in range(40):
        seg = {
            "seg_row": int(rng.integers(0, 4)), "seg_col": int(rng.integers(0, 200)), "segment_h": 300, "segment_w": 400, "expected_h": int(rng.integers(1, 301)),
            "expected_w": int(rng.integers(1, 401)), "origin_x": float(rng.uniform(3e5, 7e5)), "origin_y": 300000.0 if k % 3 == 0 else 5.5e6,
            "density": float(rng.choice([0.5, 2, 3, 7.3, 50])), "epsg": [2180, 32634, None][k % 3],
        }
        if k % 9 == 2:
            seg |= {"origin_x": -3.0, "origin_y": 50.0, "density": float(rng.choice([1e-5, 1e-3, 5e-3]))}
        iy, ix = grids._indices(seg, 0.0025)
        assert np.array_equal((iy << 32) + ix, np.concatenate(list(grids._lattice(seg, 0.0025))))


def test_the_projection_is_not_computed_for_every_cell(monkeypatch):
    asked, of = [], grids.geodesy.degrees_of
    monkeypatch.setattr(grids.geodesy, "degrees_of", lambda x, y, epsg: asked.append(np.size(x)) or of(x, y, epsg))
    seg = {"seg_row": 1, "seg_col": 2, "segment_h": 300, "segment_w": 400, "expected_h": 300, "expected_w": 400, "origin_x": 500000.0, "origin_y": 5.5e6, "density": 2.0, "epsg": 32634}
    grids._indices(seg, 0.0025)
    assert sum(asked) < 120_000 / 20


def test_runs_of_streets_make_the_same_tiles(spark):
    """Runs that overlap, end beyond the raster or cross segments set the cells that their cells set."""
    meta = spark.createDataFrame([("c", 13, 25, 500000.0, 5500000.0, 2.0, 5, 10, 32634)], city_store.META)
    altitude = grids.segments(meta).selectExpr(
        "city", "seg_row", "seg_col", "expected_h h", "expected_w w", "transform(sequence(1, expected_h * expected_w), i -> cast(i as float)) altitude")
    rows = [("c", r, c, c + n, float(res)) for r, c, n, res in ((0, 3, 4, 0), (0, 5, 10, 1), (4, 9, 1, 0), (5, 0, 24, 1), (7, 8, 13, 0), (12, 20, 5, 1), (13, 0, 3, 1))]
    runs = spark.createDataFrame(rows, "city string, row int, col int, last int, is_residential double")
    cells = runs.select("city", "row", F.explode(F.sequence("col", "last")).alias("col"), "is_residential").groupBy("city", "row", "col").agg(
        F.max("is_residential").alias("is_residential"))
    by_runs, by_cells = ({(r.seg_row, r.seg_col): r for r in grids.dense_tiles(x, meta, altitude).collect()} for x in (runs, cells))
    assert len(by_cells) == 9 and by_runs == by_cells


def test_rasters_of_many_cities_shuffle_runs(spark):
    from workload import q_cities

    roads = spark.createDataFrame(
        [("c", [(500000.0, 5500000.0), (500300.0, 5500000.0)], 8.0, True), ("c", [(500100.0, 5499900.0), (500160.0, 5500200.0)], 6.0, False)],
        "city string, geometry array<struct<x: double, y: double>>, width_m double, is_residential boolean")
    requests = spark.createDataFrame([("c", 2.0, 40, 50, 32634)], "city string, density double, segment_h int, segment_w int, epsg int")
    pieces = grids.raster.street_pieces(roads, "city", "is_residential")
    bounds = grids.raster.piece_bounds(pieces, "city")
    cells = grids.rasterise(pieces, bounds, requests)
    runs = grids.rasterise(pieces, bounds, requests, runs=True)
    assert 4 * runs.count() < cells.count()
    spread = runs.select("row", F.explode(F.sequence("col", "last")).alias("col"), "is_residential").groupBy("row", "col").agg(F.max("is_residential"))
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, cells.drop("city").collect()))
    plan = q_cities.many_cities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # no row per position of a tile


def test_batches_of_the_tile_log_are_read_a_few_at_once(spark, tmp_path):
    log = TileLog(spark, str(tmp_path / "store"))
    tiles = spark.range(60).select(
        F.lit("c").alias("city"), F.col("id").cast("int").alias("seg_row"), F.lit(0).alias("seg_col"), F.lit(1).cast("bigint").alias("arrived"),
        F.array_repeat(F.lit(1.0).cast("float"), 50).alias("data"))
    log.commit(0, tiles.coalesce(1))
    assert sum(row_groups(tmp_path / "store/tiles")) == 60 and max(row_groups(tmp_path / "store/tiles")) <= 8


def test_deliveries_of_the_ingest_are_read_a_few_at_once(spark, tmp_path, monkeypatch):
    from workload import q_samples

    monkeypatch.setattr(q_samples, "scratch_path", lambda spark, label: str(tmp_path / label))
    monkeypatch.setattr("cobblestone.session.scratch_path", lambda spark, label: str(tmp_path / label))
    assert q_samples.ingest_progress(spark, "/root/testdata/sf0.1").count() == 4
    for folder in ("arrivals", "arriving"):
        rows = row_groups(tmp_path / folder)
        assert sum(rows) > 50 and max(rows) <= 8


def test_blocks_meet_windows_by_area_not_by_window(spark, monkeypatch):
    """Also where windows crowd in one area, cross into the next or see nothing."""
    monkeypatch.setattr(sampling, "_AREA", 32)
    monkeypatch.setattr(sampling, "_CUT", 5)
    shape = sampling.SampleShape(size=16, surplus=8, inputs=3, outputs=1)
    rng = np.random.default_rng(17)
    dense = {c: rng.random((80, 80, 2)).astype(np.float32) * (rng.random((80, 80, 1)) < 0.4) for c in "ab"}
    dense["b"][40:] = 0  # blocks without a cell
    cells = [(c, int(y), int(x), *map(float, g[y, x]), 1.0) for c, g in dense.items() for y, x in zip(*np.nonzero(g[..., 0]))]
    df = spark.createDataFrame(cells, "city string, row int, col int, is_street double, altitude double, is_residential double")
    at = [(k, "ab"[k % 2], int(rng.integers(0, 65)), int(rng.integers(0, 20 if k < 40 else 65)), 16, 16) for k in range(80)]
    windows = spark.createDataFrame(at, "sample_id bigint, city string, y0 int, x0 int, h int, w int")
    arrays = sampling.sample_arrays(windows, df, shape)
    got = {r.sample_id: r for r in arrays.collect()}
    assert len(got) == 80
    for k, city, y0, x0, _, _ in at:
        cut = dense[city][y0 : y0 + 16, x0 : x0 + 16]
        want = np.concatenate([np.zeros((16, 16, 1), np.float32), cut], axis=2)
        want[4:12, 4:12, 0], want[4:12, 4:12, 1] = 1, 0
        assert np.array_equal(np.array(got[k].x, np.float32).reshape(16, 16, 3), want)
        assert np.array_equal(np.array(got[k].y_is_street, np.float32).reshape(8, 8), cut[4:12, 4:12, 0])
    plan = arrays._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan  # no block per window


def test_stored_samples_are_read_a_few_at_once(spark, tmp_path, monkeypatch):
    from cobblestone.streaming import samples as stream_samples

    monkeypatch.setattr(stream_samples, "array_files", lambda values: {"parquet.block.row.count.limit": str(2**10 // values)})
    cells = spark.createDataFrame([(r, c, 1.0, 0.0, 0.0) for r in range(30) for c in range(30)], "row int, col int, is_street double, altitude double, is_residential double")
    grid = spark.createDataFrame([("a", 0, 30, 30)], "city string, city_no int, rows int, cols int")
    spark.range(40).select(F.col("id").alias("sample_id")).coalesce(1).write.parquet(str(tmp_path / "ids"))
    stream = spark.readStream.schema("sample_id bigint").parquet(str(tmp_path / "ids"))
    shape = sampling.SampleShape(size=8, surplus=4, inputs=2, outputs=1)
    stream_samples.generate(stream, grid, cells, shape, (20, 20), str(tmp_path / "out"), str(tmp_path / "state"), endless=False).awaitTermination()
    assert sum(row_groups(tmp_path / "out")) == 40 and max(row_groups(tmp_path / "out")) <= 5


def test_tiles_of_inference_are_read_a_few_at_once(spark, tmp_path, monkeypatch):
    from cobblestone.plans import inference

    monkeypatch.setattr(inference, "scratch_path", lambda spark, label: str(tmp_path / label))
    cells = spark.range(72 * 72).selectExpr("cast(id div 72 as int) row", "cast(id % 72 as int) col", "1D is_street", "0D altitude", "0D is_residential").where("row % 3 = 0")
    out = inference.predict(cells, 72, 72, sampling.SampleShape(size=16, surplus=8), lambda r, c: (r + c) % 4 == 1)
    assert out.count() == 64 * 64
    for folder in ("tile-inputs", "tiles"):
        rows = row_groups(tmp_path / folder)
        assert sum(rows) == 64 and max(rows) <= 8


def test_arms_are_computed_once(spark):
    """Not once per direction of an edge and again for each side of the join that pairs them."""
    from cobblestone.operators import curvature

    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 0.0), (3, 0.0, 40.0)], "node_id bigint, x double, y double")
    line = lambda a, b: [dict(x=float(a[0]), y=float(a[1])), dict(x=float(b[0]), y=float(b[1]))]
    edges = spark.createDataFrame(
        [(1, 2, 0, line((0, 0), (40, 0))), (3, 1, 0, line((0, 40), (0, 0))), (2, 2, 0, line((40, 0), (40, 0)))],
        "u bigint, v bigint, k int, geometry array<struct<x: double, y: double>>")
    plan = curvature.arms(nodes, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    radii = curvature.node_radii(nodes, edges)
    (row,) = radii.collect()
    assert (row.node, row.n1, row.n2) == (1, 2, 3) and abs(row.radius - 50**0.5) < 1e-6
    assert "min_by" not in radii._jdf.queryExecution().optimizedPlan().toString()
