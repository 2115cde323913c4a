"""Turning radii of a street graph at its nodes (G14) and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cobblestone.functions import geodesy, planar
from cobblestone.operators import network
from cobblestone.session import cut_lineage

# Arm length, class limits in metres.
ARM_M = 10.0
SHARP_M = 30.0
STRAIGHT_M = 1000.0


def arms(nodes: DataFrame, edges: DataFrame, reach: float = ARM_M) -> DataFrame:
    """The point ``reach`` along the edge from every node to every neighbour (P12): (node, n, at, arm).

    The first edge (smallest k) from the node is used, else the first one to it.
    """
    lines = edges.where(F.col("u") != F.col("v")).select("u", "v", "k", "geometry")
    # both ends from one row: a union would compute the geometry twice
    way = [F.struct(F.col(a).alias("node"), F.col(b).alias("n"), F.struct(F.lit(i).alias("turned"), "k").alias("rank")) for i, a, b in ((0, "u", "v"), (1, "v", "u"))]
    ends = lines.select("geometry", F.explode(F.array(*way)).alias("e")).select("e.*", "geometry")
    first = ends.groupBy("node", "n").agg(F.min_by("geometry", "rank").alias("geometry"))
    at = nodes.select(F.col("node_id").alias("node"), planar.point(F.col("x"), F.col("y")).alias("at"))
    return first.join(at, "node").select("node", "n", "at", planar.arm_point(F.col("geometry"), F.col("at"), reach).alias("arm"))


def node_radii(nodes: DataFrame, edges: DataFrame, reach: float = ARM_M) -> DataFrame:
    """Radius of every pair of neighbours at every node, split into street and junction turns.

    Whether a node is on a street or a junction goes by its directed degree. All
    pairs are the result; the equi-join on the node is skew-split by Spark.
    """
    arm = cut_lineage(arms(nodes, edges, reach), "arms")  # both sides of a join
    one = arm.select("node", F.col("n").alias("n1"), "at", F.col("arm").alias("p"))
    two = arm.select("node", F.col("n").alias("n2"), F.col("arm").alias("r"))
    pairs = one.join(two, "node").where(F.col("n1") < F.col("n2"))
    radius = planar.circumradius(F.col("p"), F.col("at"), F.col("r"), planar.CURVATURE_GUARD)
    degree = network.degrees(edges).select(F.col("node_id").alias("node"), "degree")
    kind = F.when(F.col("degree") <= 2, F.lit("street")).otherwise(F.lit("junction"))
    return pairs.join(degree, "node").select("node", "n1", "n2", kind.alias("kind"), radius.alias("radius"))


def project_graph(nodes: DataFrame, edges: DataFrame):
    """A graph in degrees moved to the UTM zone of its centre (one zone, a one-row lookup)."""
    zone = nodes.agg(geodesy.utm_epsg(F.avg("x"), F.avg("y")).alias("epsg"))
    moved = nodes.join(F.broadcast(zone)).withColumn("m", geodesy.to_projected(F.col("x"), F.col("y"), F.col("epsg")))
    moved = moved.withColumn("x", F.col("m.x")).withColumn("y", F.col("m.y")).drop("m", "epsg")
    lines = edges.join(F.broadcast(zone)).withColumn(
        "geometry",
        F.transform("geometry", lambda p: geodesy.to_projected(p["x"], p["y"], F.col("epsg"))),
    ).drop("epsg")
    return moved, lines


def radius_report(radii: DataFrame) -> DataFrame:
    """Count, mean, minimum and maximum per class: sharp, gentle, straight."""
    kind = (
        F.when(F.col("radius") > STRAIGHT_M, F.lit("straight"))
        .when(F.col("radius") <= SHARP_M, F.lit("sharp"))
        .otherwise(F.lit("gentle"))
    )
    finite = F.when(F.col("radius") < planar.INFINITY, F.col("radius"))
    return radii.groupBy(kind.alias("turn_class")).agg(
        F.count("*").alias("turns"), F.avg(finite).alias("mean_radius"), F.min(finite).alias("min_radius"),
        F.max(finite).alias("max_radius"),
    )


def mean_slope(edges: DataFrame) -> DataFrame:
    return edges.agg(F.avg("slope").alias("mean_slope"), F.count("slope").alias("edges"))


def normalised_histogram(values: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Share of values per interval (A15); the shares add up to 1.

    Values outside [low, high] fall into the first or last interval.
    """
    width = (high - low) / bins
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width))).cast("int")
    index = F.when(F.col(value) == planar.INFINITY, F.lit(bins - 1)).otherwise(index)
    counted = values.where(F.col(value).isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.join(F.broadcast(total)).select(
        (low + F.col("bin") * width).alias("interval_start"), (low + (F.col("bin") + 1) * width).alias("interval_end"),
        (F.col("n") / F.col("total")).alias("share"),
    )
