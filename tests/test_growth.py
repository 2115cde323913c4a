"""Steps whose time or memory grew faster than their tables: right results, and a plan that stays in proportion."""

import numpy as np
from pyspark.sql import functions as F

from cobblestone.operators import morphology, reach, sampling, street_tiles, streets
from cobblestone.sources import citygrid
from cobblestone.streaming import samples as stream_samples
from workload.fixtures import view

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def raster(spark, image):
    rows, cols = np.nonzero(image)
    return spark.createDataFrame([(int(r), int(c)) for r, c in zip(rows, cols)], "row int, col int")


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_nodes_are_dealt_to_tasks_before_they_become_cells(spark):
    plan = plan_of(view(spark, SMALL, "fx_streets"))
    spread = [line for line in plan.splitlines() if "Repartition" in line]
    assert len(spread) == 2 and all(int("".join(filter(str.isdigit, s.split("Repartition")[1].split(",")[0]))) >= 32 for s in spread)


def test_border_cells_by_tiles(spark):
    rng = np.random.default_rng(3)
    h, w = 37, 29
    image = rng.random((h, w)) < 0.85
    wide = np.pad(image, 1, constant_values=True)
    full = np.logical_and.reduce([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)])
    df = morphology.border_cells(raster(spark, image), h, w, tile=8)
    assert told(df) == sorted(zip(*(x.tolist() for x in np.nonzero(image & ~full))))
    assert "Aggregate" not in plan_of(df)  # no vote per cell and neighbour


def test_flood_looks_around_the_cells_that_stop_it(spark):
    rng = np.random.default_rng(5)
    image, free = rng.random((20, 20)) < 0.8, rng.random((20, 20)) < 0.7
    cells = spark.createDataFrame([(int(r), int(c), bool(free[r, c]) if free[r, c] or (r + c) % 2 else None) for r, c in zip(*np.nonzero(image))], "row int, col int, free boolean")
    starts = [(int(r), int(c)) for r, c in zip(*np.nonzero(image))][::7] + [(int(r), int(c)) for r, c in zip(*np.nonzero(~image))][:3]
    handles = spark.createDataFrame([(k, r, c) for k, (r, c) in enumerate(starts)], "handle_id bigint, row int, col int")
    out = reach.flood(cells, handles, F.col("free"))
    want = []
    for k, start in enumerate(starts):
        seen, todo = set(), [start] if image[start] else []
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            if free[at]:
                near = [(at[0] + i, at[1] + j) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))]
                todo += [p for p in near if min(p) >= 0 and max(p) < 20 and image[p]]
        want += [(k, *p) for p in seen]
    assert told(out.visited().select("handle_id", "row", "col")) == sorted(want)
    assert out.cells._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # cells that pass are not sorted out again


def test_lines_march_together(spark):
    rng = np.random.default_rng(7)
    mask, altitude = rng.random((60, 70)) < 0.9, rng.random((60, 70))
    lines = [(np.clip(np.cumsum(rng.integers(-1, 2, n)) + 30, 0, 59), np.clip(np.cumsum(rng.integers(-1, 2, n)) + 30, 0, 69)) for n in (1, 2, 3, 4, 9, 40)]
    lines.append((np.full(5, 10), np.full(5, 10)))  # never moves

    def alone(r, c):
        p = [(i, min(i + 3, len(r) - 1)) for i in range(0, len(r) - 1, 3)]
        width, along, drop = [], [0.0], [0.0]
        for i, j in p:
            d = np.array([r[j] - r[i], c[j] - c[i]], float)
            size = np.hypot(*d)
            if not size:
                continue
            along.append(abs(altitude[r[j], c[j]] - altitude[r[i], c[i]]) / size)
            sides = []
            for sign in (1, -1):
                at, n, last = np.array([r[i], c[i]], float), 0, altitude[r[i], c[i]]
                while n < 101:
                    y, x = np.rint(at + sign * np.array([-d[1], d[0]]) / size).astype(int)
                    if not (0 <= y < 60 and 0 <= x < 70 and mask[y, x]):
                        break
                    at, n, last = at + sign * np.array([-d[1], d[0]]) / size, n + 1, altitude[y, x]
                sides.append((n, last))
            if sides[0][0] + sides[1][0]:
                width.append(sides[0][0] + sides[1][0])
                drop.append(abs(sides[0][1] - sides[1][1]) / width[-1])
        return [np.median(width) if width else 0.0, max(along), max(drop)]

    got = streets.lines_metrics([r for r, _ in lines], [c for _, c in lines], mask, altitude, 1.0)
    assert np.allclose(got, [alone(r, c) for r, c in lines])


def test_clean_tiles_equal_the_two_steps(spark):
    rng = np.random.default_rng(11)
    image = rng.random((45, 38)) < 0.45
    rows = [(int(r), int(c), float(image[r, c]), float(r + c) if (r * c) % 5 else None) for r in range(45) for c in range(38) if image[r, c] or rng.random() < 0.3]
    cells = spark.createDataFrame(rows, "row int, col int, is_street double, altitude double")
    closed = morphology.close_cross(morphology.remove_small_objects(raster(spark, image)), 45, 38)
    ground = {(r, c): a or 0.0 for r, c, _, a in rows}
    want = sorted((r, c, ground.get((r, c), 0.0)) for r, c in told(closed))
    got = morphology.clean_tiles(cells, 45, 38, tile=16)
    assert len(want) > 100 and told(got) == want
    assert "Join" not in plan_of(got)


def test_small_tiles_share_a_task(spark):
    image = np.zeros((130, 170), bool)
    image[20:23], image[80:84], image[:, 30:33], image[:, 100:104] = True, True, True, True
    cells = raster(spark, image).withColumn("altitude", F.col("row") * 0.5)
    skeleton = morphology.skeletonise(cells, 130, 170)
    tiling = street_tiles.Tiling(130, 170, 40, 50)
    parts = street_tiles.graph_parts(cells, skeleton, tiling)
    ground, lines = ({(r.row, r.col): r for r in df.collect()} for df in (cells, skeleton))
    at = np.array([*ground, *lines])
    altitude = np.array([r.altitude for r in ground.values()] + [np.nan] * len(lines))
    thin = np.arange(len(at)) >= len(ground)
    want = [row for i in range(4) for j in range(4) for row in street_tiles.tile_graph(i, j, at[:, 0], at[:, 1], altitude, thin, tiling)]
    got = parts.collect()
    brief = lambda r: (r[0], r[1], r[2], r[3], r[4], r[7] or 0, r[11] or 0.0)
    assert len(want) > 30 and sorted(map(brief, got)) == sorted(map(brief, want))
    assert parts.groupBy("tile_row", "tile_col").count().count() > 4
    assert "750" in plan_of(parts) and "760" in plan_of(parts)  # squares of 19 x 15 tiles are dealt, not tiles


def test_many_windows_of_one_block_are_cut_in_groups(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_MEET", 3)
    shape = sampling.SampleShape(size=16, surplus=8)
    rng = np.random.default_rng(13)
    cells = {(c, int(r), int(k)): float(rng.random()) for c in "ab" for r, k in zip(*np.nonzero(rng.random((40, 40)) < 0.3))}
    df = spark.createDataFrame([(c, r, k, 1.0, v, None if r % 3 else 1.0) for (c, r, k), v in cells.items()], "city string, row int, col int, is_street double, altitude double, is_residential double")
    at = [(k, "ab"[k % 2], int(rng.integers(0, 25)), int(rng.integers(0, 25)), 16, 16) for k in range(20)]
    windows = spark.createDataFrame(at, "sample_id bigint, city string, y0 int, x0 int, h int, w int")
    want = []
    for k, city, y0, x0, _, _ in at:
        for r in range(16):
            for c in range(16):
                v, hid = cells.get((city, r + y0, c + x0)), 4 <= r < 12 and 4 <= c < 12
                if v is not None or hid:
                    want.append((k, r, c, int(hid), 0.0 if hid else 1.0, v or 0.0, (v or 0.0) if hid else -1.0))
    got = sampling.sample_cells(windows, df, shape)
    assert told(got.select("sample_id", "row", "col", "is_predicted", "is_street", "altitude", F.coalesce("y_altitude", F.lit(-1.0)))) == sorted(want)
    assert "Join LeftAnti" not in plan_of(got)  # no row per window and position in a join


def test_stream_of_samples_reads_the_raster_once(spark, tmp_path, monkeypatch):
    made = []
    whole = sampling.block_arrays
    monkeypatch.setattr(sampling, "block_arrays", lambda *a: made.append(1) or whole(*a))
    cells = spark.createDataFrame([(r, c, 1.0, 0.0, 0.0) for r in range(30) for c in range(30)], "row int, col int, is_street double, altitude double, is_residential double")
    grids = spark.createDataFrame([("a", 0, 30, 30)], "city string, city_no int, rows int, cols int")
    spark.range(12).select(F.col("id").alias("sample_id")).repartition(3).write.parquet(str(tmp_path / "ids"))
    stream = spark.readStream.schema("sample_id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ids"))
    shape = sampling.SampleShape(size=16, surplus=8, inputs=2, outputs=1)
    stream_samples.generate(stream, grids, cells, shape, (20, 20), str(tmp_path / "out"), str(tmp_path / "state"), endless=False).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 12 and len(made) == 1


def test_tiles_reach_the_grid_file_as_arrow(spark):
    from pyspark.sql.datasource import DataSourceArrowWriter

    assert issubclass(citygrid.CityGridWriter, DataSourceArrowWriter)
    citygrid.register(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("16m", "16777216", "16777216b")


def test_a_delivery_is_written_by_several_tasks(spark, monkeypatch):
    from workload import q_samples

    def refused(self, n):
        raise AssertionError(f"coalesce({n})")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
    rows = q_samples.ingest_progress(spark, SMALL).orderBy("batch").collect()
    assert len(rows) > 1 and rows[-1].share == 1.0
