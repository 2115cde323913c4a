"""The pass over tiles against the same steps in tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cobblestone.operators import morphology, street_graph, street_tiles, streets
from cobblestone.session import cut_lineage


def city(seed, h, w):
    rng = np.random.default_rng(seed)
    image = np.zeros((h, w), bool)
    for _ in range(14):
        y, x, k = rng.integers(0, h), rng.integers(0, w), rng.integers(2, 6)
        if rng.random() < 0.4:
            image[y : y + k, x : x + rng.integers(20, 90)] = True
        elif rng.random() < 0.6:
            image[y : y + rng.integers(20, 90), x : x + k] = True
        else:
            for i in range(rng.integers(15, 60)):
                image[min(y + i, h - 1), min(x + i // 2, w - 1) : x + i // 2 + k] = True
    return image


@pytest.mark.parametrize("seed, tile", [(1, (50, 64)), (2, (40, 40)), (3, (200, 200))])
def test_tiles_equal_the_steps_in_tables(spark, seed, tile):
    h, w = 130, 150
    rows, cols = np.nonzero(city(seed, h, w))
    altitude = np.sin(rows / 9) * 3 + cols * 0.01
    mask = cut_lineage(spark.createDataFrame(pd.DataFrame({"row": rows.astype("int32"), "col": cols.astype("int32"), "altitude": altitude})), "mask")
    skeleton = cut_lineage(morphology.skeletonise(mask, h, w), "skeleton")
    crossings, cells = (cut_lineage(x, "found") for x in streets.discover(skeleton, h, w, *tile))
    lines = streets.order_streets(cells, streets.street_ends(streets.junctions(crossings, cells)))
    # a halo as wide as the march, so that it is not cut; discovery keeps its own
    measured = streets.street_metrics(lines, mask, h, w, *tile, halo=streets.HALO + streets.MARCH_LIMIT + 1)
    pieces = streets.clip_lines(measured, h, w, *tile)
    owned = street_graph.crossroad_nodes(crossings, *tile)
    want_nodes, want_edges = street_graph.assemble(crossings, owned, pieces)
    parts = cut_lineage(street_tiles.graph_parts(mask, skeleton, street_tiles.Tiling(h, w, *tile)), "parts")
    nodes, edges = street_graph.from_parts(parts)
    rounded = lambda df: sorted(map(str, df.select("u", "v", "k", "geometry", F.round("slope", 9).alias("s"), F.round("width", 9).alias("w")).collect()))
    assert rounded(edges) == rounded(want_edges) and edges.count() > 5
    assert sorted(map(str, nodes.select("node_id", "y", "x", "type").collect())) == sorted(map(str, want_nodes.select("node_id", "y", "x", "type").collect()))
    assert nodes.where("type = 'crossroad'").count() > 1


def test_an_empty_raster_has_no_graph(spark):
    mask = spark.createDataFrame([], "row int, col int, altitude double")
    assert street_tiles.graph_parts(mask, mask.select("row", "col"), street_tiles.Tiling(50, 50, 20, 20)).count() == 0
