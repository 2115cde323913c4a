"""Flood reachability on street cells (G16) and the opposite side of a street."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.functions import lattice
from cobblestone.operators import components
from cobblestone.session import cut_lineage


@dataclass(frozen=True)
class Flood:
    """What floods reach (G16), in rows linear in cells and handles.

    ``handles`` is (handle_id, row, col, label), the component each flood is in (null where it stops at once); ``cells`` is
    (label, row, col), the component's cells and the cells around it that are visited but pass nothing on.
    """

    handles: DataFrame
    cells: DataFrame

    def sizes(self) -> DataFrame:
        """Cells visited from each handle: (handle_id, cells)."""
        counts = self.cells.groupBy("label").agg(F.count("*").alias("cells"))
        return self.handles.join(counts, "label", "left").select("handle_id", F.coalesce("cells", F.lit(1)).alias("cells"))

    def visited(self) -> DataFrame:
        """Every cell of every flood: (handle_id, row, col)."""
        alone = self.handles.where("label is null").select("handle_id", "row", "col")
        return alone.union(self.handles.select("handle_id", "label").join(self.cells, "label").select("handle_id", "row", "col"))


def flood(cells: DataFrame, handles: DataFrame, predicate: Column) -> Flood:
    """Street cells a 4-neighbour flood visits from each handle (handle_id, row, col).

    A visited cell passes the flood on only where ``predicate`` holds (a Column over
    the cell's columns). What passes it on is one component of the passing cells, so
    the flood takes the few rounds of component labelling instead of one per step.
    """
    passes = F.bool_or(F.coalesce(predicate, F.lit(False))).alias("passes")
    street = cut_lineage(cells.groupBy("row", "col").agg(passes), "street")
    passing = components.label_cells(street.where("passes").select("row", "col"), lattice.ORTHOGONAL)
    passing = cut_lineage(passing.select("label", "row", "col"), "passing")
    # a neighbour that passes on has the component itself, so only the others look around them
    stops = street.where("not passes").select("row", "col", F.col("row").alias("_row"), F.col("col").alias("_col"))
    beside = lattice.spread(stops, lattice.ORTHOGONAL, "_row", "_col").select("row", "col", "_row", "_col")
    rim = beside.join(passing, ["row", "col"]).select("label", F.col("_row").alias("row"), F.col("_col").alias("col")).distinct()
    starts = handles.join(street.select("row", "col"), ["row", "col"], "left_semi").join(passing, ["row", "col"], "left")
    return Flood(starts.select("handle_id", "row", "col", "label"), passing.unionByName(rim))


def reachable(cells: DataFrame, handles: DataFrame, predicate: Column) -> DataFrame:
    """Every cell of every flood: (handle_id, row, col); handles times the cells of their components."""
    return flood(cells, handles, predicate).visited()


def opposite_cells(borders: DataFrame, height: int, width: int, first_reach: int = 4) -> DataFrame:
    """For every border cell the nearest cell of another border (Manhattan, then raster order).

    Looks within ``first_reach`` by an equi-join on squares of that size; cells that
    found nothing look again twice as far, until the whole raster is covered.
    """
    left = borders.select("row", "col", "label")
    found, reach = None, first_reach
    while True:
        shift = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        # the side that is copied is the one that shrinks from round to round
        near = left.withColumn(
            "br", F.explode(F.transform(shift, lambda s: lattice.floor_div(F.col("row"), reach) + s))
        ).withColumn("bc", F.explode(F.transform(shift, lambda s: lattice.floor_div(F.col("col"), reach) + s)))
        far = borders.select(
            F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("label").alias("to_label"),
            lattice.floor_div(F.col("row"), reach).alias("br"), lattice.floor_div(F.col("col"), reach).alias("bc"),
        )
        metres = F.abs(F.col("row") - F.col("to_row")) + F.abs(F.col("col") - F.col("to_col"))
        pairs = near.join(far, ["br", "bc"]).where((F.col("label") != F.col("to_label")) & (metres <= reach))
        best = pairs.groupBy("row", "col", "label").agg(
            F.min(F.struct(metres.alias("distance"), "to_row", "to_col")).alias("m")
        ).select("row", "col", "label", "m.distance", "m.to_row", "m.to_col")
        best = cut_lineage(best, "opposite")
        found = best if found is None else found.union(best)
        left = cut_lineage(left.join(best, ["row", "col"], "left_anti"), "unmatched")
        if reach >= height + width or left.isEmpty():
            return found
        reach = min(reach * 2, height + width)
