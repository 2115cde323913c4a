"""Grid files, sampling, tiled inference and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cobblestone.operators import raster, sampling
from cobblestone.plans import city, inference, training
from cobblestone.sources import citygrid, grid_meta
from cobblestone.sources.network import uniform_tags
from cobblestone.sources import growing_logs
from cobblestone.sources.tile_log import TileLog
from cobblestone.streaming import ingest, log_monitor, samples

NAMES = list(raster.CHANNELS)


def noise(spark, h, w, seed=1, share=0.5):
    rng = np.random.default_rng(seed)
    dense = np.zeros((h, w, 3))
    on = rng.random((h, w)) < share
    dense[on] = np.column_stack([rng.random(on.sum()) < 0.7, rng.integers(1, 50, on.sum()), rng.random(on.sum()) < 0.3])
    rows, cols = np.nonzero(on)
    frame = pd.DataFrame({"row": rows.astype("int32"), "col": cols.astype("int32")} | {n: dense[rows, cols, k] for k, n in enumerate(NAMES)})
    return dense, spark.createDataFrame(frame)


@pytest.mark.parametrize("order", ["little", "big"])
def test_grid_file_round_trip_and_segment_pushdown(spark, tmp_path, order):
    dense, cells = noise(spark, 66, 50)
    citygrid.register(spark)
    path = str(tmp_path / "noise.grid_city")
    tiles = raster.dense_tiles(cells, 66, 50, 30, 40)
    assert tiles.count() == 6
    options = {"rows": 66, "cols": 50, "segment_h": 30, "segment_w": 40, "byteorder": order}
    tiles.write.format("citygrid").options(**options).mode("append").save(path)
    back = spark.read.format("citygrid").load(path).toPandas()
    got = np.zeros_like(dense)
    got[back["row"], back["col"]] = back[NAMES]
    assert len(back) == 66 * 50 and np.array_equal(got, dense.astype("float32"))
    every = [(r.seg_row, r.seg_col, r.row, r.col) for r in spark.read.format("citygrid").load(path).collect()]
    for test, keep in (("seg_row in (0, 2) and seg_col >= 1", lambda a, b, r, c: a in (0, 2) and b >= 1), ("row > 7 and col <= 12", lambda a, b, r, c: r > 7 and c <= 12),
                       ("row = 9", lambda a, b, r, c: r == 9), ("seg_row < 1 or col = 3", lambda a, b, r, c: a < 1 or c == 3)):
        some = spark.read.format("citygrid").option("shareBytes", 100).load(path).where(test)
        assert sorted((r.seg_row, r.seg_col, r.row, r.col) for r in some.collect()) == sorted(x for x in every if keep(*x))
    part = spark.read.format("citygrid").load(path).where("seg_row = 2 AND seg_col = 1")
    assert part.rdd.getNumPartitions() == 1 and part.count() == 6 * 10
    meta = grid_meta.parse_headers(grid_meta.read_headers(spark, path)).first()
    assert (meta["rows"], meta["segment_w"], meta["byteorder"]) == (66, 40, order)


def test_a_tile_of_wrong_shape_is_refused(spark, tmp_path):
    _, cells = noise(spark, 20, 20)
    citygrid.register(spark)
    options = {"rows": 30, "cols": 20, "segment_h": 30, "segment_w": 20}
    with pytest.raises(Exception, match="must be 30 x 20"):
        raster.dense_tiles(cells, 20, 20, 30, 20).write.format("citygrid").options(**options).mode("append").save(str(tmp_path / "x"))


def test_bad_header_fails_only_when_strict(spark):
    df = spark.createDataFrame([("1;2;3",)], "header string")
    assert grid_meta.parse_headers(df, strict=False).first()["rows"] is None
    with pytest.raises(Exception, match="10 fields"):
        grid_meta.parse_headers(df).collect()


def test_sample_arrays_equal_slices(spark):
    dense, cells = noise(spark, 90, 100)
    shape = sampling.SampleShape(size=24, surplus=8)
    grids = spark.createDataFrame([("a", 0, 90, 100)], "city string, city_no int, rows int, cols int")
    windows = sampling.sample_windows(sampling.random_cuts(sampling.sample_ids(spark, 40), grids, 40, 50), shape)
    where = {r["sample_id"]: (r["y0"], r["x0"]) for r in windows.collect()}
    assert len(set(where.values())) > 20
    for r in sampling.sample_arrays(windows, cells, shape).collect():
        y0, x0 = where[r["sample_id"]]
        cut = dense[y0 : y0 + 24, x0 : x0 + 24].astype("float32")
        x = np.array(r["x"], "float32").reshape(24, 24, 4)
        want = np.concatenate([np.zeros((24, 24, 1), "float32"), cut], axis=2)
        want[4:20, 4:20, 0], want[4:20, 4:20, 1], want[4:20, 4:20, 3] = 1, 0, 0
        assert np.array_equal(x, want)
        assert np.array_equal(np.array(r["y_altitude"], "float32").reshape(16, 16), cut[4:20, 4:20, 1])


def test_tile_plan_of_the_worked_example(spark):
    plan = inference.tile_plan(spark, 100, 100, sampling.SampleShape(size=40, surplus=16)).collect()
    assert sorted({r["y0"] for r in plan}) == [0, 24, 48, 60]
    assert all(r["wave"] == r["c"] + 2 * r["r"] for r in plan)


@pytest.mark.parametrize("rows, cols", [(100, 100), (97, 131), (72, 90)])
@pytest.mark.parametrize("size, surplus", [(40, 16), (24, 16), (20, 12)])
def test_every_dependency_is_in_an_earlier_wave(spark, rows, cols, size, surplus):
    shape = sampling.SampleShape(size=size, surplus=surplus)
    plan = inference.tile_plan(spark, rows, cols, shape)
    assert inference.tile_dependencies(plan, rows, cols, shape).where("need_wave >= wave").count() == 0


def predict_in_turn(grid, shape):
    """Tile after tile in row-major order with feedback, on one array."""
    size, half, stride = shape.size, shape.crop, shape.size - shape.surplus
    out = np.zeros((grid.shape[0] - shape.surplus, grid.shape[1] - shape.surplus, 3))
    done = np.zeros(out.shape[:2], dtype=bool)
    for y in inference._starts(out.shape[0], stride):
        for x in inference._starts(out.shape[1], stride):
            tile = grid[y : y + size, x : x + size].astype("float32").copy()
            hidden = tile[..., 0] == 1
            tile[hidden, 1], tile[hidden, 3] = 0, 0
            tile[:half, :, 0] = tile[-half:, :, 0] = tile[:, :half, 0] = tile[:, -half:, 0] = 0
            for i in range(size):
                for j in range(size):
                    gy, gx = y + i - half, x + j - half
                    zone = i < half or (i < size - half and j < half)
                    if zone and 0 <= gy < out.shape[0] and 0 <= gx < out.shape[1] and done[gy, gx]:
                        tile[i, j, 1:] = out[gy, gx]
            p = inference.neighbourhood_share(tile[None], shape)[0]
            p[..., [0, 2]] = p[..., [0, 2]] > 0.5
            out[y : y + stride, x : x + stride], done[y : y + stride, x : x + stride] = p, True
    return out


def test_waves_give_the_sequential_prediction(spark):
    dense, cells = noise(spark, 43, 50, seed=9, share=0.9)
    hide = np.zeros((43, 50))
    hide[5:40, 8:44] = 1
    shape = sampling.SampleShape(size=20, surplus=8)
    got = inference.predict(cells, 43, 50, shape, lambda r, c: r.between(5, 39) & c.between(8, 43)).toPandas()
    # every hidden position is masked, also those without a cell in the sparse input
    want = predict_in_turn(np.dstack([hide, dense]), shape)
    full = np.zeros_like(want)
    full[got["row"], got["col"]] = got[NAMES]
    assert len(got) == 35 * 42
    assert np.array_equal(full[..., [0, 2]], want[..., [0, 2]])
    assert np.allclose(full[..., 1], want[..., 1], atol=1e-3)


def test_elevation_enrichment_of_a_metric_grid(spark):
    """100 x 100 street grid at (424000, 5546000), density 10: every cell gets the one known elevation."""
    cells = spark.range(10000).select(
        F.floor(F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"),
        F.lit(1.0).alias("is_street"), F.lit(0.0).alias("altitude"), F.lit(0.0).alias("is_residential"))
    elevation = spark.createDataFrame([(50, 19, 123.0)], "iy int, ix int, elevation double")
    got = raster.add_elevation(cells, elevation, 424000.0, 5546000.0, 10.0, 1.0)
    assert got.agg(F.min("altitude"), F.max("altitude"), F.min("is_street")).first() == (123.0, 123.0, 1.0)
    assert got.count() == 10000


def test_city_roads_and_grid(spark):
    nodes = spark.createDataFrame([(1, 19.90, 50.05), (2, 19.902, 50.05), (3, 19.904, 50.0505)], "node_id long, x double, y double")
    edges = uniform_tags(spark.createDataFrame([(1, 2, 0, "Long", "residential", "6"), (2, 3, 0, "Long", "residential", None)],
                                               "u long, v long, k int, name string, highway string, width string"))
    roads = city.city_roads(nodes, edges)
    got = {r["u"]: r for r in roads.collect()}
    assert got[1]["width_m"] == 6 and got[2]["width_m"] == pytest.approx(3.0)
    assert got[1]["length_m"] == pytest.approx(142.8, abs=0.5) and len(got[1]["ring"]) == 4
    cells = city.city_grid(roads, 40, 50, 2.0)
    assert cells.where("is_street = 1").count() > 300 and cells.where("is_residential = 1").count() == 0


def test_ingest_keeps_the_last_arrival_and_reports_progress(spark, tmp_path):
    """An older tile that comes late loses; a second start goes on after the first; the states written on the way agree."""
    kind = "city string, seg_row int, seg_col int, arrived bigint, data array<float>"
    rows = [("x", i % 2, i // 2 % 3, a, [float(a)]) for i, a in enumerate([5, 9, 3, 8, 7, 2, 6, 1, 4, 10, 0, 11])]
    folder, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    seen = []
    for part in (rows[:8], rows[8:]):
        for i in range(0, len(part), 2):
            spark.createDataFrame(part[i : i + 2], kind).coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.tile_stream(spark, folder, kind, max_files=1)
        ingest.ingest(stream, store, state, 6, lambda share, text: seen.append((round(6 * share), text)), every=4).awaitTermination()
    want = {}
    for city, r, c, a, _ in rows:
        want[r, c] = max(want.get((r, c), -1), a)
    log = TileLog(spark, store, every=4)
    assert {(t.seg_row, t.seg_col): t.data[0] for t in log.tiles(kind).collect()} == want
    assert log.head().batch == 5 and log.head().done == 6
    assert [n for n, _ in seen] == [2, 4, 6, 6, 6, 6] and seen[-1][1] == "batch 5 saved"
    assert {(e.seg_row, e.seg_col): e.arrived for e in log.entries().collect()} == want
    assert [r.added for r in ingest.progress(spark, store).orderBy("batch").collect()] == [2, 2, 2, 0, 0, 0]


def growing(path, text):
    with open(path, "a", encoding="utf-8") as file:
        file.write(text)


def test_lines_appended_to_a_known_log_count(spark, tmp_path):
    """Cut lines wait, an epoch announced before a restart counts after it, long logs are read in pieces."""
    logs, store, state = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "state")
    logs.mkdir()

    def watch():
        log_monitor.monitor(log_monitor.log_stream(spark, str(logs), piece_bytes=64), store, state).awaitTermination()
        rows = log_monitor.best_so_far(spark, store).collect()
        return {(r.run.rsplit("/", 1)[1], r.metric): (r.best_epoch, r.best_value) for r in rows}

    growing(logs / "a", "is_street_loss: 9\nperforming 1-th epoch\nval_is_street_x: 0.5 - is_street_loss: 2\n" + "noise\n" * 50 + "performing 2-th ep")
    assert watch() == {("a", "val_is_street_x"): (1, 0.5), ("a", "is_street_loss"): (1, 2.0)}
    growing(logs / "a", "och\nval_is_street_x: 0.7\nval_is_street_x: 0.")
    growing(logs / "b", "")
    assert watch()["a", "val_is_street_x"] == (2, 0.7)
    growing(logs / "a", "9\r\nperforming 3-th epoch\nval_is_street_x: 0.9\n")
    growing(logs / "b", "performing 7-th epoch\nval_is_street_x: -1\n")
    assert watch() == {("a", "val_is_street_x"): (2, 0.9), ("a", "is_street_loss"): (1, 2.0), ("b", "val_is_street_x"): (7, -1.0)}
    metrics = [(r.epoch, r.value) for r in log_monitor.metrics_so_far(spark, store).where("run like '%a' and metric = 'val_is_street_x'").orderBy("at").collect()]
    assert metrics == [(1, 0.5), (2, 0.7), (2, 0.9), (3, 0.9)]


@pytest.mark.parametrize("piece", [1, 3, 7, 1000])
def test_pieces_of_a_log_hold_every_line_once(tmp_path, piece):
    text = "a\n\nbcd\n" + "x" * 20 + "\n\n\nlast\nopen"
    (tmp_path / "l").write_text(text)
    reader = growing_logs.GrowingLogReader({"path": str(tmp_path), "piecebytes": str(piece)})
    end = reader.latestOffset()
    lines = [r for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for r in zip(b["at"].to_pylist(), b["value"].to_pylist())]
    assert [v for _, v in lines] == text.split("\n")[:-1]
    assert all(text[at : at + len(v)] == v and (at == 0 or text[at - 1] == "\n") for at, v in lines)
    (tmp_path / "l").write_text("a\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(end, reader.latestOffset())


def test_many_small_logs_share_a_task(tmp_path):
    """A task for every piece of every file made the monitor's tasks grow with its files."""
    texts = {str(tmp_path / f"{k:04}"): "".join(f"line {k} {i}\n" for i in range(k % 7)) for k in range(600)}
    for path, text in texts.items():
        (tmp_path / path).write_text(text)
    reader = growing_logs.GrowingLogReader({"path": str(tmp_path), "piecebytes": "16", "tasks": "8"})
    tasks = reader.partitions({}, reader.latestOffset())
    assert 4 <= len(tasks) <= 9
    lines = sorted((r["file"], r["at"], r["value"]) for t in tasks for b in reader.read(t) for r in b.to_pylist())
    want = [(p, sum(len(x) + 1 for x in t.split("\n")[:i]), v) for p, t in texts.items() for i, v in enumerate(t.split("\n")[:-1])]
    assert lines == sorted(want)
    sizes = {f"/logs/{k}": growing_logs.TASK_BYTES // 4 for k in range(50)} | {"/logs/long": 10 * growing_logs.TASK_BYTES}
    tasks = growing_logs.GrowingLogReader({"path": "/logs", "tasks": "8"}).partitions({}, sizes)
    assert max(sum(p.last - p.first for p in t.pieces) for t in tasks) <= 2 * growing_logs.TASK_BYTES
    assert sum(p.last - p.first for t in tasks for p in t.pieces) == sum(sizes.values())


def test_every_metric_of_a_log_with_its_best_so_far(spark, tmp_path):
    """Rows in any order, ties, values that are no number, lines before the first epoch; in two batches."""
    logs, store, state = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "state")
    logs.mkdir()
    rng, want = np.random.default_rng(4), []
    texts = {run: ["is_street_a: 99"] for run in "ab"}
    for run, lines in texts.items():
        best = {}
        for epoch in range(1, 41):
            lines.append(f"performing {epoch}-th epoch")
            for _ in range(rng.integers(0, 3)):
                found = [(m, "e" if rng.random() < 0.2 else int(rng.integers(-2, 9))) for m in ("is_street_a", "val_is_street_b")[: rng.integers(1, 3)]]
                lines.append(" - ".join(f"{m}: {v}" for m, v in found))
                for m, v in found:
                    v = None if v == "e" else float(v)
                    if v is not None and v > best.get(m, (None, -np.inf))[1]:
                        best[m] = epoch, v
                    want.append((run, epoch, m, v, *best.get(m, (None, None))))
    for part in (slice(0, 50), slice(50, None)):
        for run, lines in texts.items():
            growing(logs / run, "".join(line + "\n" for line in lines[part]))
        log_monitor.monitor(log_monitor.log_stream(spark, str(logs), piece_bytes=64), store, state).awaitTermination()
    rows = log_monitor.metrics_so_far(spark, store).collect()
    got = [(r.run[-1], r.epoch, r.metric, r.value, r.best_epoch, r.best_value) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_features_of_tiles_equal_those_of_samples(spark):
    """What the fitted model sees in tiled inference is what it was trained on."""
    _, cells = noise(spark, 60, 60)
    shape = sampling.SampleShape(size=24, surplus=8)
    windows = spark.createDataFrame([(1, "a", 3, 5, 24, 24), (2, "a", 30, 20, 24, 24)], "sample_id bigint, city string, y0 int, x0 int, h int, w int")
    samples = sampling.sample_cells(windows, cells, shape)
    arrays = sampling.sample_arrays(windows, cells, shape).orderBy("sample_id").collect()
    x = np.stack([np.asarray(r.x, float).reshape(24, 24, shape.inputs) for r in arrays])
    got = training.tile_features(x, shape)
    rows = training.border_features(samples, windows, shape).collect()
    assert len(rows) == 2 * 16 * 16
    for r in rows:
        assert [r[c] for c in training.FEATURES] == got[r.sample_id - 1, r.row - 4, r.col - 4].tolist()
    model = training.StreetModel((1.0, 1.0, 1.0, 1.0, 0.1, 0.1, -0.2), -1.0)
    y = model(x, shape)
    assert y.shape == (2, 16, 16, shape.outputs) and ((0 < y[..., 0]) & (y[..., 0] < 1)).all()


def test_endless_samples(spark, tmp_path):
    _, cells = noise(spark, 60, 60)
    grids = spark.createDataFrame([("a", 0, 60, 60)], "city string, city_no int, rows int, cols int")
    shape = sampling.SampleShape(size=24, surplus=8)
    stream = samples.sample_stream(spark, 5)
    query = samples.generate(stream, grids, cells, shape, (30, 30), str(tmp_path / "samples"), str(tmp_path / "state"))
    try:
        for _ in range(120):
            if query.lastProgress and query.lastProgress["batchId"] >= 2:
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    stored = spark.read.parquet(str(tmp_path / "samples"))
    assert stored.where("batch < 2").select("sample_id").distinct().count() == 10
    assert stored.first()["x"] is not None


def test_empty_hidden_cells_are_masked_too(spark):
    """One row of cells on a raster of 20 x 20: all 144 hidden positions reach the model as hidden."""
    cells = spark.createDataFrame([(9, c, 1.0, 0.0, 0.0) for c in range(20)], "row int, col int, is_street double, altitude double, is_residential double")
    shape = sampling.SampleShape(size=20, surplus=8)
    seen = lambda x, s: np.repeat(x[:, s.crop : -s.crop, s.crop : -s.crop, :1], s.outputs, axis=3)
    got = inference.predict(cells, 20, 20, shape, lambda r, c: r.between(4, 15) & c.between(4, 15), seen).toPandas()
    assert len(got) == 144 and (got["is_street"] == 1).all()


def test_a_graph_without_snaps_stays(spark):
    from cobblestone.operators import street_graph

    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 9.0, 0.0), ("c", 50.0, 50.0)], "node_id string, x double, y double")
    edges = spark.createDataFrame([("a", "b", 0, [(0.0, 0.0), (9.0, 0.0)], 0.0, 3.0)], "u string, v string, k int, geometry array<struct<x:double,y:double>>, slope double, width double")
    none = spark.createDataFrame([], "node_id string, winner string")
    kept, lines = street_graph.contract(nodes, edges, none)
    assert kept.count() == 3 and lines.count() == 1


def test_segments_of_a_grid_beyond_32_bits(spark):

    meta = spark.createDataFrame([(60_000, 60_000, 5_000, 5_000, 3, 40)], "rows int, cols int, segment_h int, segment_w int, channels int, header_bytes int")
    last = grid_meta.segment_catalogue(meta).where("seg_row = 11 and seg_col = 11").first()
    assert last.byte_start + last.byte_length == 40 + 60_000 * 60_000 * 3 * grid_meta.VALUE_BYTES


def test_an_existing_grid_file_is_not_overwritten(spark, tmp_path):

    citygrid.register(spark)
    tile = spark.createDataFrame([(0, 0, 2, 2, 3, [1.0] * 12)], "seg_row int, seg_col int, h int, w int, channels int, data array<float>")
    write = lambda: tile.write.format("citygrid").options(rows=2, cols=2, segment_h=2, segment_w=2).mode("append").save(str(tmp_path / "g"))
    write()
    before = (tmp_path / "g").read_bytes()
    with pytest.raises(Exception, match="exists"):
        write()
    assert (tmp_path / "g").read_bytes() == before and len(list(tmp_path.iterdir())) == 1


def test_blocks_of_tiles_give_the_sequential_prediction(spark):
    """More than a block of tiles in both directions, the last row and column moved; a job cuts all windows, one more per diagonal of blocks."""
    dense, cells = noise(spark, 75, 83, seed=4, share=0.9)
    hide = np.zeros((75, 83))
    hide[4:71, 4:79] = 1
    shape = sampling.SampleShape(size=12, surplus=6)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("blocks", "tiled inference")
    try:
        got = inference.predict(cells, 75, 83, shape, lambda r, c: r.between(4, 70) & c.between(4, 78)).toPandas()
        taken = tracker.getJobIdsForGroup("blocks")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = predict_in_turn(np.dstack([hide, dense]), shape)
    full = np.zeros_like(want)
    full[got["row"], got["col"]] = got[NAMES]
    assert len(got) == want.shape[0] * want.shape[1]
    assert np.array_equal(full[..., [0, 2]], want[..., [0, 2]])
    assert np.allclose(full[..., 1], want[..., 1], atol=1e-3)
    assert len(taken) <= 50
