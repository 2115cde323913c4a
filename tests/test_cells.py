"""Components and morphology against plain Python on random masks."""

import numpy as np
import pandas as pd
import pytest

from cobblestone.functions import lattice
from cobblestone.operators import components, morphology, reach
from pyspark.sql import functions as F


def mask(seed, h, w, share):
    return np.random.default_rng(seed).random((h, w)) < share


def cells(spark, image):
    rows, cols = np.nonzero(image)
    return spark.createDataFrame(pd.DataFrame({"row": rows.astype("int32"), "col": cols.astype("int32")}))


def image_of(df, h, w):
    out = np.zeros((h, w), dtype=bool)
    for r in df.select("row", "col").collect():
        out[r["row"], r["col"]] = True
    return out


def flood_labels(image, offsets):
    label = {}
    for start in zip(*np.nonzero(image)):
        if start in label:
            continue
        stack, label[start] = [start], start
        while stack:
            y, x = stack.pop()
            for i, j in offsets:
                n = (y + i, x + j)
                if 0 <= n[0] < image.shape[0] and 0 <= n[1] < image.shape[1] and image[n] and n not in label:
                    label[n] = start
                    stack.append(n)
    return label


@pytest.mark.parametrize("offsets, share", [(lattice.AROUND, 0.35), (lattice.ORTHOGONAL, 0.55)])
@pytest.mark.parametrize("block", [8, 64])
def test_labels_match_flood_fill(spark, offsets, share, block):
    image = mask(3, 50, 60, share)
    want = {k: (int(v[0]) << 32) + int(v[1]) for k, v in flood_labels(image, offsets).items()}
    got = {(r["row"], r["col"]): r["label"] for r in components.label_cells(cells(spark, image), offsets, block).collect()}
    assert got == want


def test_link_components_with_a_hub_and_a_chain(spark):
    hub = [(0, i) for i in range(1, 400)]
    chain = [(i, i + 1) for i in range(1000, 1200)]
    df = spark.createDataFrame(hub + chain + [(5000, 4000), (4000, 5000), (7, 7)], "a long, b long")
    got = {r["item"]: r["component"] for r in components.link_components(df).collect()}
    assert {got[i] for i in range(400)} == {0} and {got[i] for i in range(1000, 1201)} == {1000}
    assert got[5000] == 4000 and len(got) == 400 + 201 + 2


def thin_plainly(image):
    """Zhang-Suen by the book, cell by cell."""
    image = np.pad(image, 1)
    step, idle = 0, 0
    while idle < 2:
        drop = []
        for y, x in zip(*np.nonzero(image)):
            if not (0 < y < image.shape[0] - 1 and 0 < x < image.shape[1] - 1):
                continue
            p = [bool(image[y + i, x + j]) for i, j in morphology.RING]
            turns = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
            a, b = ((p[0] and p[2] and p[4]), (p[2] and p[4] and p[6])) if step % 2 == 0 else ((p[0] and p[2] and p[6]), (p[0] and p[4] and p[6]))
            if 2 <= sum(p) <= 6 and turns == 1 and not a and not b:
                drop.append((y, x))
        for at in drop:
            image[at] = False
        idle = 0 if drop else idle + 1
        step += 1
    return image[1:-1, 1:-1]


@pytest.mark.parametrize("tile, passes", [(16, 3), (64, 8)])
def test_thinning_is_seam_free_and_exact(spark, tile, passes):
    image = np.zeros((40, 44), dtype=bool)
    image[10:15], image[:, 20:24], image[30:34, 24:] = True, True, True
    framed = np.pad(image, morphology.THINNING_PAD, constant_values=True)
    want = thin_plainly(framed)[5:-5, 5:-5]
    got = image_of(morphology.skeletonise(cells(spark, image), 40, 44, tile, passes), 40, 44)
    assert np.array_equal(got, want) and not (got & ~image).any()
    assert len(set(flood_labels(got, lattice.AROUND).values())) == 1


def test_closing_is_extensive_and_idempotent(spark):
    image = mask(5, 30, 30, 0.4)
    once = morphology.close_cross(cells(spark, image), 30, 30)
    twice = image_of(morphology.close_cross(once, 30, 30), 30, 30)
    once = image_of(once, 30, 30)
    assert not (image & ~once).any() and np.array_equal(once, twice)


def test_small_objects(spark):
    image = np.zeros((20, 20), dtype=bool)
    image[0, :9], image[5, :10], image[10, 10] = True, True, True
    kept = image_of(morphology.remove_small_objects(cells(spark, image)), 20, 20)
    assert kept.sum() == 10 and kept[5, :10].all()


def test_crossroads_need_three_runs(spark):
    three, two = np.zeros((9, 9), dtype=bool), np.zeros((9, 9), dtype=bool)
    for bit in (0, 2, 4):
        three[4 + morphology.RING[bit][0], 4 + morphology.RING[bit][1]] = True
    for bit in (0, 4):
        two[4 + morphology.RING[bit][0], 4 + morphology.RING[bit][1]] = True
    found = image_of(morphology.crossroad_cells(cells(spark, three), 9, 9), 9, 9)
    assert found[3:6, 3:6].all() and found.sum() == 9
    assert morphology.crossroad_cells(cells(spark, two), 9, 9).count() == 0


def test_dilation_and_border(spark):
    image = mask(8, 25, 30, 0.1)
    want = np.zeros_like(image)
    for y, x in zip(*np.nonzero(image)):
        want[max(y - 3, 0) : y + 4, max(x - 3, 0) : x + 4] = True
    assert np.array_equal(image_of(morphology.dilate_square(cells(spark, image), 25, 30, 3), 25, 30), want)
    inner = np.zeros_like(want)
    for y, x in zip(*np.nonzero(want)):
        inner[y, x] = want[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].all()
    assert np.array_equal(image_of(morphology.border_cells(cells(spark, want), 25, 30), 25, 30), want & ~inner)


def test_flood_stops_where_the_predicate_fails(spark):
    image = mask(2, 20, 20, 0.8)
    street = cells(spark, image)
    start = tuple(int(v[0]) for v in np.nonzero(image))
    handle = spark.createDataFrame([(1, *start)], "handle_id int, row int, col int")
    seen, queue = {start}, [start]
    while queue:
        y, x = queue.pop()
        if y % 7 == 6 or x % 7 == 6:
            continue
        for i, j in lattice.ORTHOGONAL:
            n = (y + i, x + j)
            if 0 <= n[0] < 20 and 0 <= n[1] < 20 and image[n] and n not in seen:
                seen.add(n)
                queue.append(n)
    got = reach.reachable(street, handle, (F.col("row") % 7 != 6) & (F.col("col") % 7 != 6))
    assert {(r["row"], r["col"]) for r in got.collect()} == seen


def test_opposite_cells_far_apart(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (40, 3, 2), (41, 3, 2)], "row int, col int, label long")
    got = {(r["row"], r["col"]): (r["distance"], r["to_row"], r["to_col"]) for r in reach.opposite_cells(df, 50, 50).collect()}
    assert got == {(0, 0): (43, 40, 3), (0, 1): (42, 40, 3), (40, 3): (42, 0, 1), (41, 3): (43, 0, 1)}


def test_segments_are_many_tasks_for_the_altitude(spark):
    """A table of segments is short, the work on each is not."""
    from cobblestone.operators import grids

    meta = spark.createDataFrame([(f"c{i}", 40, 50, 500000.0 + i, 5500000.0, 2.0, 20, 25, 32634) for i in range(12)], "city string, rows int, cols int, origin_x double, origin_y double, density double, segment_h int, segment_w int, epsg int")
    places = spark.range(100).selectExpr("cast(19855 + id % 10 as int) iy", "cast(8398 + floor(id / 10) as int) ix", "cast(id as double) elevation")
    tiles = grids.elevation_tiles(meta, places, 0.0025)
    assert tiles.count() == 48
    assert tiles.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_sides_of_a_segment_name_the_places_of_all_its_cells():
    """Also west of Greenwich, where places are negative, and not for cells wider than the lattice."""
    import numpy as np
    from cobblestone.operators import grids

    seg = {"seg_row": 1, "seg_col": 2, "segment_h": 300, "segment_w": 400, "expected_h": 300, "expected_w": 350, "origin_x": 350000.0, "origin_y": 5500000.0, "density": 3.0, "epsg": 2180}
    for epsg in (2180, 32634, None):
        for origin in (350000.0, 700000.0, -3.0):
            own = seg | {"epsg": epsg, "origin_x": origin} | ({"origin_y": 50.0, "density": 1e-5} if origin < 0 and epsg is None else {})
            want = np.unique(np.concatenate([p.ravel() for p in grids._lattice(own, 0.0025)]))
            assert np.isin(want, grids._box(own, 0.0025)).all()
            iy, ix = grids._apart(want)
            assert np.array_equal((iy << 32) + ix, want)
    assert grids._box(seg | {"density": 9000.0, "expected_h": 3, "expected_w": 3}, 0.0025) is None
