import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cobblestone.operators import spatial, street_graph, streets
from cobblestone.plans import reconstruct


def test_breadth_first_ends():
    #  0-1-2-3-4 with a side branch 2-5-6-7
    links = {0: [1], 1: [0, 2], 2: [1, 3, 5], 3: [2, 4], 4: [3], 5: [2, 6], 6: [5, 7], 7: [6]}
    walk = lambda s: streets.longest_branches(*streets.breadth_first([links[i] for i in range(8)], s))
    assert walk(0) == (7, 0)  # one way out: the start itself is the second end
    assert walk(1) == (7, 0)
    assert walk(2) == (7, 0)  # 4 and 0 are equally deep: the branch that came first
    assert streets.longest_branches(*streets.breadth_first([[]], 0)) == (0, 0)


def test_street_band_metrics():
    """A band ten cells wide that climbs 0.1 per row: width near 10, slope 0.1 along, none across."""
    mask, altitude = np.zeros((100, 100), dtype=bool), np.zeros((100, 100))
    mask[20:80, 45:55] = True
    altitude[20:80, 45:55] = (np.arange(20, 80)[:, None] - 20) * 0.1
    rows = np.arange(20, 80)
    width, along, across = streets.line_metrics(rows, np.full(60, 49), mask, altitude, 1.0)
    assert width == 9 and along == pytest.approx(0.1) and across == 0


def test_march_rounds_half_to_even_and_stops_at_its_limit():
    mask, altitude = np.ones((1, 400), dtype=bool), np.arange(400.0)[None, :]
    length, last = streets.march(np.array([[0, 10]]), np.array([[0.0, 1.0]]), mask, altitude)
    assert (length[0], last[0]) == (101, 111)


def test_clip_line_pieces():
    x, y = np.array([0, 10, 10, 0, 0.0]), np.array([0, 0, 5, 5, 9.0])
    parts = streets.clip_line(x, y, (2, -1, 8, 6))
    assert [list(zip(px, py)) for px, py in parts] == [[(2, 0), (8, 0)], [(8, 5), (2, 5)]]
    assert streets.clip_line(x, y, (20, 20, 30, 30)) == []
    (px, py), = streets.clip_line(x, y, (-1, -1, 20, 20))
    assert list(px) == list(x) and list(py) == list(y)


def test_snapping_keeps_crossroads_first(spark):
    nodes = spark.createDataFrame(
        [("b", 0.0, 0.0, "connector"), ("a", 0.0, 4.0, "connector"), ("z", 0.0, 8.5, "crossroad"), ("q", 0.0, 14.0, "crossroad"), ("r", 3.0, 14.0, "crossroad")],
        "node_id string, y double, x double, type string")
    got = {r["node_id"]: r["winner"] for r in street_graph.snap_winners(nodes).collect()}
    assert got == {"a": "z", "b": "z", "z": "z", "q": "q", "r": "q"}


def test_closeness_links_have_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    pts = pd.DataFrame({"id": np.arange(400), "x": rng.random(400) * 120, "y": rng.random(400) * 120})
    pts.loc[:150, ["x", "y"]] = [3.0, 3.0]  # a third of all points on one spot
    df = spark.createDataFrame(pts)

    def groups(links):
        parent = list(range(400))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(400)]

    few = [(r["id_a"], r["id_b"]) for r in spatial.closeness_links(df, 5.0).collect()]
    every = [(r["id_a"], r["id_b"]) for r in spatial.pairs_within(df, 5.0).collect()]
    assert groups(few) == groups(every) and len(few) < len(every) / 5


@pytest.mark.parametrize("tile", [(120, 120), (50, 60)])
def test_square_with_cross(spark, tile):
    """A square with a cross: nine crossings, twelve streets between them, whatever the tiling."""
    n = 120
    image = np.zeros((n, n), dtype=bool)
    for at in (15, 57, 99):
        image[at : at + 6, 15:105] = True
        image[15:105, at : at + 6] = True
    rows, cols = np.nonzero(image)
    cells = spark.createDataFrame(pd.DataFrame({"row": rows.astype("int32"), "col": cols.astype("int32"), "is_street": 1.0, "altitude": cols * 0.05}))
    nodes, edges = reconstruct.snapped_graph(cells, reconstruct.Grid(n, n, *tile))
    nodes, edges = nodes.toPandas(), edges.select("u", "v", "slope", "width").toPandas()
    crossings = nodes[nodes["type"] == "crossroad"]
    # the corners bend without a third street; the five inner meeting points are crossroads
    assert len(crossings) == 5
    assert {(round(y / 42), round(x / 42)) for y, x in zip(crossings["y"] - 18, crossings["x"] - 18)} == {(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)}
    ends = set(edges["u"]) | set(edges["v"])
    assert set(crossings["node_id"]) <= ends
    assert edges["slope"].max() <= 0.2 and 3 <= edges["width"].median() <= 8


def test_analysis_has_features_and_radii(spark):
    rows, cols = np.nonzero(np.add.outer((np.abs(np.arange(80) - 40) < 3), (np.abs(np.arange(80) - 40) < 3)))
    cells = spark.createDataFrame(pd.DataFrame({"row": rows.astype("int32"), "col": cols.astype("int32"), "is_street": 1.0, "altitude": 0.0}))
    assert reconstruct.snapped_graph(cells, reconstruct.Grid(80, 80, 80, 80))[1].count() == 0  # all four are dead ends
    out = reconstruct.analyse(cells, reconstruct.Grid(80, 80, 80, 80, 1.0, 50.0, 20.0, far_ends=True))
    assert out.features.count() == out.edges.count() == 4
    assert out.radii.where(F.col("kind") == "junction").count() == 6
    assert out.features.first()["feature"].startswith('{"type":"Feature","geometry":{"type":"LineString"')
