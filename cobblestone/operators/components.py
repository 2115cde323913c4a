"""Connected components of raster cells and of links.

Raster cells are labelled block by block (a block is a bounded square, labelled in
one task), and only the links that cross block borders go into the distributed
iteration. That keeps the iterated table at a small fraction of the cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cobblestone.functions import lattice
from cobblestone.session import cut_lineage


def group_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each of ``n`` items' component, given links a-b."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        if np.array_equal(pa, pb):
            return parent
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped


def neighbour_links(rows: np.ndarray, cols: np.ndarray, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of cells that are neighbours; the cells come sorted in raster order."""
    top, left, width = rows.min(), cols.min() - 1, int(cols.max() - cols.min()) + 3
    key = (rows - top) * width + (cols - left)
    ends = []
    for i, j in offsets:
        if (i, j) > (0, 0):  # each undirected link once
            at = np.searchsorted(key, key + i * width + j)
            at[at == len(key)] = 0
            hit = np.flatnonzero(key[at] == key + i * width + j)
            ends.append((hit, at[hit]))
    return np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])


def label_within(cells: DataFrame, keys: list[str], offsets=lattice.AROUND) -> DataFrame:
    """Components inside each group of ``keys`` (a bounded tile): adds ``label``, the smallest cell key."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        rows, cols = pdf["row"].to_numpy("int64"), pdf["col"].to_numpy("int64")
        a, b = neighbour_links(rows, cols, offsets)
        root = group_labels(len(pdf), a, b)
        return pdf.assign(label=(rows[root] << 32) + cols[root])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields) + ", label bigint"
    return cells.groupBy(*keys).applyInPandas(label, schema)


def link_components(links: DataFrame) -> DataFrame:
    """Component of every item in ``links`` (a, b): (item, component), component = smallest item.

    Large-star / small-star rounds (Kiveris et al. 2014). Every round is two
    combinable minimum aggregates and two equi-joins; a hub shows up as a join key
    that Spark's skew handling splits, never as one collected list.
    """
    edges = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")
    ).distinct()
    edges = cut_lineage(edges, "links")
    state = None
    while True:
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = edges.select(F.col("big").alias("item"), F.col("small").alias("other")).union(
            edges.select("small", "big")
        )
        least = both.groupBy("item").agg(F.min("other").alias("lowest"))
        moved = both.where(F.col("other") > F.col("item")).join(least, "item").select(
            F.col("other").alias("big"), F.least("lowest", "item").alias("small")
        ).distinct()
        # small star: smaller neighbours and the item itself go to the smallest neighbour
        lowest = moved.groupBy("big").agg(F.min("small").alias("lowest"))
        pulled = moved.join(lowest, "big")
        star = pulled.where(F.col("small") != F.col("lowest")).select(F.col("small").alias("big"), F.col("lowest").alias("small"))
        star = star.union(lowest.select("big", F.col("lowest").alias("small"))).distinct()
        edges = cut_lineage(star, "stars")
        # a fixed point of both steps is a set of stars; compared by size and hash of the written table
        before, state = state, edges.agg(
            F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
    roots = edges.select(F.col("small").alias("item")).distinct().select("item", F.col("item").alias("component"))
    return edges.select(F.col("big").alias("item"), F.col("small").alias("component")).union(roots)


def label_cells(cells: DataFrame, offsets=lattice.AROUND, block: int = 256) -> DataFrame:
    """Components of a whole raster (G1): adds ``label``, the smallest cell key of the component."""
    blocked = cells.withColumn("_br", lattice.floor_div(F.col("row"), block)).withColumn(
        "_bc", lattice.floor_div(F.col("col"), block)
    )
    local = cut_lineage(label_within(blocked, ["_br", "_bc"], offsets).withColumnRenamed("label", "_local"), "blocks")
    row_in, col_in = F.pmod(F.col("row"), F.lit(block)), F.pmod(F.col("col"), F.lit(block))
    rim = local.where(row_in.isin(0, block - 1) | col_in.isin(0, block - 1)).select("row", "col", "_br", "_bc", "_local")
    # each rim cell looks across the border from one side only
    forward = [o for o in offsets if o > (0, 0)]
    reach = lattice.spread(rim.withColumnRenamed("_local", "a"), forward, "_br", "_bc", "a")
    crossing = reach.where(
        (lattice.floor_div(F.col("row"), block) != F.col("_br")) | (lattice.floor_div(F.col("col"), block) != F.col("_bc"))
    ).select("row", "col", "a")
    links = crossing.join(rim.select("row", "col", F.col("_local").alias("b")), ["row", "col"]).select("a", "b").distinct()
    merged = link_components(links).select(F.col("item").alias("_local"), F.col("component").alias("_merged"))
    return local.join(merged, "_local", "left").withColumn("label", F.coalesce("_merged", "_local")).drop(
        "_local", "_merged", "_br", "_bc"
    )


def component_summary(labelled: DataFrame, height: int, width: int) -> DataFrame:
    """Size, centroid and border-touching cells of every component."""
    return labelled.groupBy("label").agg(
        F.count("*").alias("size"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"),
        F.count_if(on_border(height, width)).alias("border_cells"),
    )


def on_border(height: int, width: int):
    return F.col("row").isin(0, height - 1) | F.col("col").isin(0, width - 1)


def split_by_border(labelled: DataFrame, height: int, width: int):
    """Cells of components that touch the raster border, and of those that do not."""
    touching = labelled.where(on_border(height, width)).select("label").distinct()
    return labelled.join(touching, "label", "left_semi"), labelled.join(touching, "label", "left_anti")
